"""Duplicate cases: superseded versions, and re-reports found by exact set similarity.

Re-reports agree in sex, rounded age and country, and both their drug and their reaction sets
have a Jaccard similarity of at least 0.8. Rows that agree in block and both sets are a class, and
classes are compared, not rows: a report that was sent a thousand times is one row of the join, and its
copies' pairs are counted and resolved by class sizes and the classes' latest members. Candidates come
from a prefix-filtered equi-join on (block, reaction, drug): tokens are ordered by how rare they are, so a
frequent drug or reaction enters few prefixes, and classes meet only where both of their sets may be
alike, so neither a large block nor a frequent token gathers its rows in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from ..storage import written

#: Fixed values.
THRESHOLD_NUMERATOR, THRESHOLD_DENOMINATOR = 4, 5
VERSION, SIMILAR = "version", "probabilistic"
BLOCK = ("sex", "age_r", "country")


def latest_publication(rows: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row a primaryid, of the last quarter within the range. The range prunes partitions first."""
    rows = in_quarters(rows, start, end)
    order = Window.partitionBy("primaryid").orderBy(F.desc("quarter"))
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def in_quarters(rows: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start:
        rows = rows.filter(F.col("quarter") >= start)
    if end:
        rows = rows.filter(F.col("quarter") <= end)
    return rows


def superseded_versions(cases: DataFrame) -> DataFrame:
    """(primaryid, canonical_primaryid) of all but the highest version (then primaryid) of each case id.

    A max over structs, so versions are reduced before the shuffle; null versions come last.
    """
    key = F.struct(F.col("caseversion").isNotNull().alias("known"), "caseversion", "primaryid")
    best = cases.groupBy("caseid").agg(F.max(key).alias("best")).select("caseid", F.col("best.primaryid").alias("canonical_primaryid"))
    same = cases["caseid"].eqNullSafe(best["caseid"])
    return cases.join(best, same).select("primaryid", "canonical_primaryid").filter("primaryid <> canonical_primaryid").distinct()


def token_sets(rows: DataFrame, column: str, name: str) -> DataFrame:
    return rows.filter(F.col(column).isNotNull()).groupBy("primaryid").agg(F.array_sort(F.collect_set(column)).alias(name))


@dataclass(frozen=True)
class Population:
    status: DataFrame  # primaryid, status
    compared: DataFrame  # the eligible rows that share their block with another
    blocks: DataFrame  # the blocks of those rows, with their members


def needed(cases: DataFrame) -> DataFrame:
    """The columns of cases that a pass reads, as a table: versions, classes and blocks go through them many times."""
    return written(cases.select("primaryid", "caseid", "caseversion", "quarter", "fda_dt", "sex", "age_years", "country"), "latest")


def population(cases: DataFrame, drugs: DataFrame, reactions: DataFrame, versions: DataFrame | None = None) -> Population:
    """Classify every case, in this order: superseded, null_key, empty_drug_set, eligible.

    ``cases`` has one row a primaryid. ``versions``: the superseded ones among them, if there already; ``cases``
    is a table then. The classified rows are a table too, as their sets are costly and several figures read them.
    """
    if versions is None:
        cases = needed(cases)
        versions = superseded_versions(cases)
    old = versions.select("primaryid", F.lit(True).alias("old"))
    drug_sets = token_sets(drugs, "drugname_raw", "drugs")
    reaction_sets = token_sets(reactions, "pt", "reactions")
    rows = cases.withColumn("age_r", F.round("age_years")).join(old, "primaryid", "left").join(drug_sets, "primaryid", "left")
    key_missing = F.col("sex").isNull() | F.col("age_years").isNull() | F.col("country").isNull()
    status = F.when(F.col("old"), "superseded").when(key_missing, "null_key").when(F.col("drugs").isNull(), "empty_drug_set").otherwise("eligible")
    rows = rows.withColumn("status", status)
    rows = written(rows.select("primaryid", "caseid", *BLOCK, "quarter", F.coalesce(F.col("fda_dt").cast("string"), F.lit("")).alias("fda_dt"), "drugs", "status"), "population")
    eligible = rows.filter("status = 'eligible'").drop("status")
    # Block sizes are counted and joined, not windowed: a window would bring a block's rows to one task.
    sizes = eligible.groupBy(*BLOCK).agg(F.count("*").alias("members")).filter("members > 1")
    compared = eligible.join(sizes.drop("members"), list(BLOCK)).join(reaction_sets, "primaryid", "left").withColumn("reactions", F.coalesce("reactions", F.array().cast("array<string>")))
    return Population(rows.select("primaryid", "status"), compared.select("primaryid", "caseid", *BLOCK, "quarter", "fda_dt", "drugs", "reactions"), sizes)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members; 0 if either set is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def _similar(a: Column, b: Column) -> Column:
    """The threshold in whole numbers, so 4/5 counts exactly."""
    both = F.size(F.array_intersect(a, b))
    return (F.size(a) > 0) & (F.size(b) > 0) & (both * THRESHOLD_DENOMINATOR >= (F.size(a) + F.size(b) - both) * THRESHOLD_NUMERATOR)


def prefix_length(n: Column) -> Column:
    """Tokens of which any two similar sets share one: n - ceil(0.8 n) + 1, at least one."""
    return F.greatest(F.lit(1), n - F.ceil(n * THRESHOLD_NUMERATOR / THRESHOLD_DENOMINATOR).cast("int") + 1)


def _ordered(rows: DataFrame, sets: list[str], keys: list[str], rarest: bool) -> DataFrame:
    """The rows with each set's tokens in one order for all rows: the rarest of the table first, or by name."""
    if not rarest:
        return rows.select("primaryid", *keys, *(F.array_sort(s).alias(s) for s in sets))
    tag = lambda s: F.transform(s, lambda t: F.struct(F.lit(s).alias("set"), t.alias("token")))
    tagged = F.concat(*map(tag, sets))
    token = rows.select("primaryid", *keys, F.explode(tagged).alias("x")).select("primaryid", *keys, "x.set", "x.token")
    frequency = token.groupBy("set", "token").agg(F.count("*").alias("f"))
    ranked = token.join(frequency, ["set", "token"])
    order = lambda s: F.array_sort(F.collect_list(F.when(F.col("set") == s, F.struct("f", "token"))))
    ranked = ranked.groupBy("primaryid", *keys).agg(*(order(s).alias(s) for s in sets))
    return ranked.select("primaryid", *keys, *(F.transform(s, lambda x: x["token"]).alias(s) for s in sets))


def candidates(compared: DataFrame, block: tuple[str, ...] = BLOCK, first: str = "reactions", rarest: bool = True, second: str | None = None) -> DataFrame:
    """(l, r), l < r, each once: pairs of rows of a block that could be similar in ``first``, and in ``second`` if given.

    Rows meet under a signature, a token of the first set's prefix with one of the second's, so two sets
    with one frequent token each and nothing in common otherwise never meet. A pair is taken at its first
    common token of each set alone, which makes it unique without a shuffle, and only if sizes and the
    tokens left after that place allow enough in common.
    """
    keys, sets = list(block), [first, *([second] if second else [])]
    rows = _ordered(compared.filter(" and ".join(f"size({s}) > 0" for s in sets)), sets, keys, rarest)
    rows = rows.select("primaryid", *keys, *(c for s in sets for c in (F.size(s).alias(f"n_{s}"), F.slice(s, F.lit(1), prefix_length(F.size(s))).alias(f"p_{s}"))))
    for s in sets:
        rows = rows.withColumn(f"t_{s}", F.explode(f"p_{s}"))
    signature = [*keys, *(f"t_{s}" for s in sets)]
    side = {k: rows.select(*signature, F.col("primaryid").alias(k), *(F.col(f"{x}_{s}").alias(f"{k}{x}_{s}") for s in sets for x in "np")) for k in "lr"}
    pairs = side["l"].join(side["r"], signature).filter("l < r")
    for s in sets:
        n, m, t = F.col(f"ln_{s}"), F.col(f"rn_{s}"), F.col(f"t_{s}")
        sized = F.least(n, m) * THRESHOLD_DENOMINATOR >= F.greatest(n, m) * THRESHOLD_NUMERATOR
        here = F.get(F.array_intersect(f"lp_{s}", f"rp_{s}"), F.lit(0)) == t
        # Nothing before the first common token is common, so this many can be.
        common = 1 + F.least(n - F.array_position(f"lp_{s}", t), m - F.array_position(f"rp_{s}", t))
        pairs = pairs.filter(sized & here & (common * (THRESHOLD_NUMERATOR + THRESHOLD_DENOMINATOR) >= (n + m) * THRESHOLD_NUMERATOR))
    return pairs.select("l", "r")


def similar_pairs(compared: DataFrame, block: tuple[str, ...] = BLOCK, first: str = "reactions", second: str | None = "drugs", rarest: bool = True, among: DataFrame | None = None) -> DataFrame:
    """(l, r, first_jaccard[, second_jaccard]) for every pair of similar rows of a block, l < r.

    Rows with the same ``caseid`` never pair (where there is such a column). It is exact and nothing is
    capped, so equal rows should be made one beforehand. ``among``: the candidates, if there already.
    """
    pairs = candidates(compared, block, first, rarest, second) if among is None else among
    own = [c for c in ("caseid", first, second) if c and c in compared.columns]
    side = {s: compared.select(F.col("primaryid").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in own)) for s in "lr"}
    pairs = pairs.join(side["l"], "l").join(side["r"], "r")
    if "caseid" in own:
        pairs = pairs.filter(~F.col("l_caseid").eqNullSafe(F.col("r_caseid")))
    for name in filter(None, (first, second)):
        a, b = F.col(f"l_{name}"), F.col(f"r_{name}")
        pairs = pairs.filter(_similar(a, b)).withColumn(f"{name}_jaccard", jaccard(a, b))
    return pairs


@dataclass(frozen=True)
class Similar:
    """Rows and their classes. A class is known by its smallest primaryid."""

    rows: DataFrame  # primaryid, caseid, quarter, fda_dt, class_id
    linked: DataFrame  # class_id, other, drugs_jaccard, reactions_jaccard: both ways, and a class with itself if its sets aren't empty
    candidates: DataFrame  # (l, r) of the classes that were compared


def similar(compared: DataFrame) -> Similar:
    """All similar rows, as links between classes of equal rows."""
    equal = F.md5(F.to_json(F.struct(*BLOCK, "drugs", "reactions")))
    keyed = written(compared.withColumn("_key", equal), "compared")
    sets = keyed.groupBy("_key").agg(F.min("primaryid").alias("primaryid"), *(F.any_value(c).alias(c) for c in (*BLOCK, "drugs", "reactions")))
    sets = written(sets, "classes")
    rows = written(keyed.join(sets.select("_key", F.col("primaryid").alias("class_id")), "_key").select("primaryid", "caseid", "quarter", "fda_dt", "class_id"), "rows")
    among = written(candidates(sets, second="drugs"), "candidates")
    links = written(similar_pairs(sets, among=among).select("l", "r", "drugs_jaccard", "reactions_jaccard"), "links")
    own = sets.filter((F.size("drugs") > 0) & (F.size("reactions") > 0)).select("primaryid", F.col("primaryid").alias("other"), F.lit(1.0), F.lit(1.0))
    both = links.union(links.select("r", "l", "drugs_jaccard", "reactions_jaccard")).union(own)
    return Similar(rows, both.toDF("class_id", "other", "drugs_jaccard", "reactions_jaccard"), among)


def link_counts(s: Similar) -> DataFrame:
    """primaryid, class_id, links, cross_quarter: the number of a row's similar rows of other cases, and of those from other quarters.

    A row's links are the sizes of the classes linked to its own, less the rows of its own case.
    """
    case = F.coalesce(F.col("caseid").cast("string"), F.lit("")).alias("case")
    rows = s.rows.select("primaryid", "class_id", "quarter", case)
    links = s.linked.select("class_id", "other")
    sizes = rows.groupBy(F.col("class_id").alias("other"), "quarter").agg(F.count("*").alias("n"))
    near = links.join(sizes, "other").groupBy("class_id", "quarter").agg(F.sum("n").alias("same"))
    every = near.groupBy("class_id").agg(F.sum("same").alias("every"))
    itself = links.filter("class_id = other").select("class_id", F.lit(1).alias("itself"))
    # Cases with one row are only linked to themselves; the few others are counted by class.
    several = rows.groupBy("case").agg(F.count("*").alias("m")).filter("m > 1").select("case")
    repeated = rows.join(several, "case").groupBy("case", "class_id", "quarter").agg(F.count("*").alias("n"))
    theirs = repeated.select("case", F.col("class_id").alias("other"), F.col("quarter").alias("q"), "n")
    own = repeated.select("case", "class_id", "quarter").join(links, "class_id").join(theirs, ["case", "other"]).groupBy("case", "class_id", "quarter").agg(F.sum("n").alias("mine"), F.coalesce(F.sum(F.when(F.col("q") == F.col("quarter"), F.col("n"))), F.lit(0)).alias("mine_same"))
    out = rows.join(every, "class_id", "left").join(near, ["class_id", "quarter"], "left").join(itself, "class_id", "left").join(own, ["case", "class_id", "quarter"], "left")
    less = lambda x: F.coalesce(x, "itself", F.lit(0))
    total, same = F.coalesce("every", F.lit(0)) - less(F.col("mine")), F.coalesce("same", F.lit(0)) - less(F.col("mine_same"))
    return out.select("primaryid", "class_id", total.alias("links"), (total - same).alias("cross_quarter"))


def canonical(s: Similar) -> DataFrame:
    """For each row that has a stronger partner, the strongest: (primaryid, canonical_primaryid, scores, cross_quarter).

    The stronger of two is the one with the later date, then the larger id; rows of one case are no
    partners. So of each class the strongest row and the strongest of any other case are enough.
    Pointers are single hops to partners actually matched; chains of them are legal.
    """
    member = F.struct("fda_dt", F.col("primaryid").alias("id"), "quarter")
    cases = s.rows.groupBy("class_id", "caseid").agg(F.max(member).alias("m"))

    def two_best(rows: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
        """By class, the strongest row, and the strongest row of another case."""
        row = F.struct("m", "caseid", *more)
        first = written(rows.groupBy("class_id").agg(F.max(row).alias("best")), "best")
        other = rows.join(first, "class_id").filter(~F.col("caseid").eqNullSafe(F.col("best.caseid")))
        return first, written(other.groupBy("class_id").agg(F.max(row).alias("second")), "second")

    first, second = two_best(cases)
    tops = first.select(F.col("class_id").alias("other"), "best.*").unionByName(second.select(F.col("class_id").alias("other"), "second.*"))
    first, second = two_best(s.linked.join(tops, "other"), "drugs_jaccard", "reactions_jaccard")
    b = F.when(~F.col("caseid").eqNullSafe(F.col("best.caseid")), F.col("best")).otherwise(F.col("second"))
    out = s.rows.join(first, "class_id").join(second, "class_id", "left").withColumn("b", b)
    out = out.filter(F.col("b").isNotNull() & (F.struct(F.col("b.m.fda_dt").alias("d"), F.col("b.m.id").alias("i")) > F.struct(F.col("fda_dt").alias("d"), F.col("primaryid").alias("i"))))
    return out.select("primaryid", F.col("b.m.id").alias("canonical_primaryid"), F.lit(SIMILAR).alias("method"), F.least("b.drugs_jaccard", "b.reactions_jaccard").alias("score"), F.col("b.drugs_jaccard").alias("drug_jaccard"), F.col("b.reactions_jaccard").alias("reaction_jaccard"), (F.col("quarter") != F.col("b.m.quarter")).alias("cross_quarter"))


def combined(versions: DataFrame, similar: DataFrame) -> DataFrame:
    """All duplicates; a record that is superseded already isn't flagged again."""
    null = F.lit(None)
    own = versions.select("primaryid", "canonical_primaryid", F.lit(VERSION).alias("method"), F.lit(1.0).alias("score"), null.cast("double").alias("drug_jaccard"), null.cast("double").alias("reaction_jaccard"), F.lit(False).alias("cross_quarter"))
    return own.unionByName(similar.join(versions.select("primaryid"), "primaryid", "left_anti"))


def accounting(p: Population) -> DataFrame:
    """One row: evaluated = superseded + null_key + empty_drug_set + eligible; eligible = compared + alone."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    states = p.status.agg(F.count("*").alias("evaluated"), count("superseded"), count("null_key"), count("empty_drug_set"), count("eligible"))
    compared = p.blocks.agg(F.coalesce(F.sum("members"), F.lit(0)).alias("compared"))
    return states.join(compared, F.lit(True)).withColumn("alone", F.col("eligible") - F.col("compared"))  # one row each


def block_figures(p: Population) -> DataFrame:
    """One row: blocks, the largest block, and the pairs that comparing all with all would take."""
    n = p.blocks.select(F.col("members").alias("n"))
    return n.agg(F.count("*").alias("blocks"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_block"), F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("naive_pairs"))


def pair_figures(s: Similar) -> DataFrame:
    """One row: similar pairs of rows, those across quarters, and the comparisons that it took (of classes)."""
    found = link_counts(s).agg(F.expr("coalesce(sum(links), 0) div 2").alias("duplicate_pairs"), F.expr("coalesce(sum(cross_quarter), 0) div 2").alias("cross_quarter_pairs"))
    return found.join(s.candidates.agg(F.count("*").alias("comparisons")), F.lit(True))  # one row each


def discarded(versions: DataFrame, similar: DataFrame) -> DataFrame:
    """One row: how many similar rows were superseded already and so weren't flagged again."""
    return similar.join(versions.select("primaryid"), "primaryid", "left_semi").agg(F.count("*").alias("discarded"))


def check_accounting(figures: dict) -> dict:
    """Raise unless the classes of the population add up."""
    if figures["evaluated"] != sum(figures[k] for k in ("superseded", "null_key", "empty_drug_set", "eligible")) or figures["eligible"] != figures["compared"] + figures["alone"] or figures["alone"] < 0:
        raise EngineError(f"the population doesn't add up: {figures}")
    return figures


def method_figures(duplicates: DataFrame) -> DataFrame:
    return duplicates.groupBy("method").agg(F.count_distinct("primaryid").alias("flagged"), F.count_if("cross_quarter").alias("cross_quarter"))
