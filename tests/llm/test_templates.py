import random
import time

import pytest

from medsentry.llm import decontaminate, urls


class Plain(decontaminate.Matcher):
    """Every window of every item against every place of the text, without an index."""

    def match(self, text):
        if not text:
            return []
        t, out = decontaminate.Text(text, self.words), {}
        for k, name in enumerate(self.names):
            size = self.own[k][0][3]
            forms = t.windows(size)
            places = range(len(forms[0]))
            hits = [(p, i, kind, size) for i, kind, h, _ in self.own[k] for p in places if h in (forms[0][p], forms[1][p]) or (h == forms[2][p] != forms[1][p])]
            hits += [(start + i, i, kind, size) for start in {p - i for p, i, *_ in hits} for i, kind, h, _ in self.blank[k] if start + i in places and forms[kind][start + i] == h]
            need = self.contained * self.total[k] - 1e-9
            if hits and len({h[1] for h in hits}) >= need and (best := self._best(k, sorted(set(hits)), t)) >= need:
                out[name] = max(out.get(name, 0.0), best / self.total[k])
        return sorted(out.items())


WORDS = "the a of and sells buys apples pears Tom Anna Maria June 3 12 45 kg miles before after. Then How many?".split()


def made(rng):
    closing = "Give the answer as one number and show all steps"
    items = []
    for k in range(40):
        body = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 22)))
        items.append((k if rng.random() < 0.9 else 0, body + (f" {closing}" if rng.random() < 0.6 else "")))
    items += [(100, "3 12 45 7 8 9"), (101, "3 12 45 7 8 9 apples 4 5 6 7 8 9"), (102, closing)]
    swap = {"Tom": "Ivan", "Anna": "Eve", "3": "8", "12": "90", "kg": "oz"}
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice(items)[1].split()
            if rng.random() < 0.5:
                words = [swap.get(w, w) for w in words]
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            parts.append(" ".join(words))
        texts.append(" ".join(parts))
    return items, texts


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("contained", [0.8, 0.5, 1.0])
def test_index_finds_what_plain_search_finds(seed, contained):
    items, texts = made(random.Random(seed))
    index, plain = decontaminate.Matcher(items, contained=contained), Plain(items, contained=contained)
    found = 0
    for text in texts:
        want = plain.match(text)
        assert index.match(text) == want
        found += bool(want)
    assert found > 10


def test_a_sentence_that_many_items_share():
    closing = "Please show every step of your work and give the final answer as a single whole number."
    items = [(i, f"Question w{i} asks how the town of v{i} sold u{i} carts of grain to s{i} in the year r{i}. {closing}") for i in range(2000)]
    m = decontaminate.Matcher(items)
    text = " ".join(f"text number t{k} goes on. {closing}" for k in range(200))
    m.match("warm up")
    began = time.time()
    assert m.match(text) == []
    assert time.time() - began < 0.5
    assert m.match(f"{text} {items[7][1]} {text}") == [(7, 1.0)]
    assert Plain(items[:20]).match(f"{text} {items[7][1]}") == [(7, 1.0)]


@pytest.mark.parametrize("in_memory", [200_000, 0])
def test_opposite_rules_of_one_name(spark, in_memory):
    """Whatever their order, block wins, as the docstring says; a longer rule still wins over both."""
    pages = spark.createDataFrame([(1, "http://a.org/x/y"), (2, "http://a.org/z"), (3, "http://b.org/x")], "page_id bigint, url string")
    both = [urls.listed_rule("allow", "a.org", "/x/"), urls.listed_rule("block", "a.org", "/x/"), urls.listed_rule("block", "a.org", "/"), urls.listed_rule("allow", "b.org", "/")]
    for rules in (both, both[::-1]):
        got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, tuple(rules), in_memory=in_memory).collect()}
        assert got == {1: ("a.org/x/", "block"), 2: ("a.org/", "block"), 3: ("b.org/", "allow")}
