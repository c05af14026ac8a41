"""A causal self-attention model over classes of subword ids, in numpy.

The frequent ids are a class each, the others share classes of about equal frequency. The model
predicts the next id's class from the classes before it, in two steps: its group of classes, then
the class within the group. The logits of both are what corpus counts give after the previous
class, plus an attention read-out. An id's share of its class comes from corpus counts, so the
probabilities of all ids sum to one.

Attention is a single head of full width, so the products of its query and key matrices, and of
its value and output matrices, are held as one matrix each.

Texts are scored in windows of ``CONTEXT + SCORED`` positions that overlap by ``CONTEXT``: every
token is scored once, and has at least CONTEXT positions before it (blanks before the start).
"""

from __future__ import annotations

import numpy as np

CONTEXT, SCORED, WIDTH = 16, 32, 16
LENGTH = CONTEXT + SCORED
GROUPS, EACH = 12, 11
CLASSES = GROUPS * EACH
SHARED = 32
OWN = CLASSES - SHARED
BLANK = CLASSES  # the input before a text's start


class Classes:
    """Class of every id, and log10 of its share of the class, from corpus counts (smoothed by 0.05)."""

    def __init__(self, counts: np.ndarray):
        n = counts + 0.05
        order = np.argsort(-n, kind="stable")
        self.of = np.empty(len(n), np.uint8)
        self.of[order[:OWN]] = np.arange(OWN)
        rest = order[OWN:]
        mass = np.cumsum(n[rest]) / n[rest].sum()
        self.of[rest] = OWN + np.minimum((mass * SHARED).astype(int), SHARED - 1)
        total = np.bincount(self.of, n, CLASSES)
        self.share = np.log10(n / total[self.of]).astype(np.float32)


def fresh(seed: int = 0) -> dict[str, np.ndarray]:
    """E: classes, P: positions, A: queries by keys, U and W: read-outs of the group and of the class in each group."""
    rng = np.random.default_rng(seed)
    d = WIDTH
    init = {"E": rng.normal(0, 0.5, (CLASSES + 1, d)), "P": rng.normal(0, 0.1, (LENGTH, d)), "A": rng.normal(0, 0.1, (d, d)), "U": np.zeros((2 * d, GROUPS)), "W": np.zeros((GROUPS, 2 * d, EACH))}
    return {k: v.astype(np.float32) for k, v in init.items()}


def bigrams(counts: np.ndarray, weight: float = 5.0) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities after each class: of each group, and of each class in its group [class * GROUPS + group, class].

    They are drawn towards those without regard to the previous class by ``weight`` counts.
    """
    n = counts.reshape(-1, GROUPS, EACH)

    def towards(n: np.ndarray) -> np.ndarray:
        one = n.sum(0, keepdims=True) + 0.5
        one /= one.sum(-1, keepdims=True)
        return np.log((n + weight * one) / (n.sum(-1, keepdims=True) + weight)).astype(np.float32)

    return towards(n.sum(2)), towards(n).reshape(-1, EACH)


# Query i (0-based among the scored) stands at position CONTEXT + i and predicts what follows it.
# The least of a logit and this hides later positions, and keeps exponents within float32.
_CAP = np.where(np.arange(LENGTH)[None, :] <= CONTEXT + np.arange(SCORED)[:, None], 30.0, -1e9).astype(np.float32)


def whole_windows(classes: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """[n, CONTEXT + 1 + SCORED]: the consecutive windows of texts that stand one after another, each with the classes before its targets."""
    sizes = np.array([len(classes)]) if sizes is None else np.asarray(sizes)
    n = -(-sizes // SCORED)
    lead, first = CONTEXT + 1, np.cumsum(n) - n  # of each text
    targets = np.full((int(n.sum()), SCORED), BLANK, np.uint8)
    targets.reshape(-1)[np.arange(len(classes)) + np.repeat(SCORED * first - (np.cumsum(sizes) - sizes), sizes)] = classes
    full = np.empty((len(targets), lead + SCORED), np.uint8)
    full[:, lead:] = targets
    full[1:, :lead] = targets[:-1, SCORED - lead :]  # all of it lies in the window before
    full[first[n > 0], :lead] = BLANK
    return full


def parts(full: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs [n, LENGTH], targets [n, SCORED] and which targets are real.

    Input p is the class before target p - CONTEXT, so a target never sees itself.
    """
    targets = full[:, CONTEXT + 1 :]
    return full[:, :LENGTH], targets, targets != BLANK


def windows(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return parts(whole_windows(classes))


#: Group of each class, and its number there; a blank counts as class 0.
_GROUP, _MEMBER = (np.append(x, 0).astype(np.uint8) for x in np.divmod(np.arange(CLASSES), EACH))


class _Targets:
    """Flat targets by group: ``order`` sorts them by group, ``runs`` are the groups' slices of that order."""

    def __init__(self, inputs: np.ndarray, targets: np.ndarray):
        t = targets.reshape(-1)
        self.group = _GROUP.take(t)
        self.order = np.argsort(self.group, kind="stable")
        ends = np.cumsum(np.bincount(self.group, minlength=GROUPS)).tolist()
        self.runs = [(g, a, b) for g, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if a < b]
        self.before = inputs[:, CONTEXT:].reshape(-1).astype(np.int64)
        self.inner_before = (self.before * GROUPS + self.group).take(self.order)
        at = np.arange(len(t))
        self.in_groups, self.in_members = at * GROUPS + self.group, at * EACH + _MEMBER.take(t.take(self.order))


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis."""
    return x @ np.ones(x.shape[-1], x.dtype)


def _attend(p: dict[str, np.ndarray], inputs: np.ndarray):
    x = p["E"].take(inputs.astype(np.int64), 0)
    x += p["P"]
    across = np.ascontiguousarray(x.transpose(0, 2, 1))
    own = np.ascontiguousarray(x[:, CONTEXT:])
    q = (own.reshape(-1, WIDTH) @ p["A"]).reshape(own.shape)
    a = np.matmul(q, across)
    np.minimum(a, _CAP, out=a)
    np.exp(a, out=a)
    scale = (1 / _sums(a))[..., None]
    h = np.matmul(a, x)
    h *= scale
    return x, across, own, q, a, scale, h, np.concatenate((h, own), -1).reshape(-1, 2 * WIDTH)


def _logits(p: dict[str, np.ndarray], grams: tuple[np.ndarray, np.ndarray], f: np.ndarray, t: _Targets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of the groups; of the classes in the target's group, in ``t.order``; and f in that order."""
    y = f @ p["U"]
    y += grams[0].take(t.before, 0)
    fs = f.take(t.order, 0)
    z = np.empty((len(f), EACH), f.dtype)
    for g, a, b in t.runs:
        np.matmul(fs[a:b], p["W"][g], out=z[a:b])
    z += grams[1].take(t.inner_before, 0)
    return y, z, fs


def log_probs(p: dict[str, np.ndarray], grams: tuple[np.ndarray, np.ndarray], inputs: np.ndarray, targets: np.ndarray, chunk: int = 128) -> np.ndarray:
    """log of the probability of each target class, [n, SCORED]; blanks get that of class 0.

    In chunks whose arrays fit a core's cache.
    """
    out = np.empty(targets.shape, p["E"].dtype)
    for i in range(0, len(inputs), chunk):
        t = _Targets(inputs[i : i + chunk], targets[i : i + chunk])
        y, z, _ = _logits(p, grams, _attend(p, inputs[i : i + chunk])[-1], t)
        inner = z.take(t.in_members)
        inner -= np.log(_sums(np.exp(z, out=z)))
        flat = y.take(t.in_groups)
        flat -= np.log(_sums(np.exp(y, out=y)))
        flat[t.order] += inner
        out[i : i + chunk] = flat.reshape(-1, SCORED)
    return out


def _add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """out[at[i]] += rows[i] for all i, by sums over sorted runs."""
    order = np.argsort(at, kind="stable")
    ordered = at.take(order)
    first = np.nonzero(np.append(True, ordered[1:] != ordered[:-1]))[0]
    out[ordered[first]] += np.add.reduceat(rows.take(order, 0), first, axis=0)


class Trainer:
    """Adam over batches of windows; the tables of counts stay as they are."""

    def __init__(self, params: dict[str, np.ndarray], grams: tuple[np.ndarray, np.ndarray], rate: float):
        self.rate, self.step, self.grams = rate, 0, grams
        self.names, kind = sorted(params), params["E"].dtype
        self.flat = np.concatenate([params[k].ravel() for k in self.names])
        self.grad, self.m, self.v = (np.zeros_like(self.flat) for _ in range(3))
        self.p, self.g, at = {}, {}, 0
        for k in self.names:  # views, so one step moves all of them
            n, shape = params[k].size, params[k].shape
            self.p[k], self.g[k] = self.flat[at : at + n].reshape(shape), self.grad[at : at + n].reshape(shape)
            at += n
        assert self.flat.dtype == kind

    def update(self, inputs: np.ndarray, targets: np.ndarray, real: np.ndarray) -> float:
        p, g = self.p, self.g
        t = _Targets(inputs, targets)
        x, across, own, q, a, scale, h, f = _attend(p, inputs)
        y, z, fs = _logits(p, self.grams, f, t)
        live = real.reshape(-1)
        weight = (live / max(1, live.sum())).astype(f.dtype)
        loss = 0.0
        for part, at, w in ((y, t.in_groups, weight), (z, t.in_members, weight.take(t.order))):
            chosen = part.take(at)
            np.exp(part, out=part)
            total = _sums(part)
            loss += float(w @ (np.log(total) - chosen))
            part *= (w / total)[:, None]
            part.reshape(-1)[at] -= w
        np.matmul(f.T, y, out=g["U"])
        df, ds = y @ p["U"].T, np.empty_like(fs)
        g["W"][:] = 0
        for k, i, j in t.runs:
            np.matmul(fs[i:j].T, z[i:j], out=g["W"][k])
            np.matmul(z[i:j], p["W"][k].T, out=ds[i:j])
        back = np.empty_like(t.order)
        back[t.order] = np.arange(len(back))
        df += ds.take(back, 0)
        df = df.reshape(len(inputs), SCORED, 2 * WIDTH)
        dh, down = np.ascontiguousarray(df[..., :WIDTH]), df[..., WIDTH:]
        base = _sums(dh * h)[..., None]
        dh *= scale  # ``a`` is not divided by its sums, so its gradients are
        da = np.matmul(dh, across)
        da -= base * scale
        da *= a
        dx = np.matmul(a.transpose(0, 2, 1), dh)
        dx += np.matmul(da.transpose(0, 2, 1), q)
        dq = np.matmul(da, x).reshape(-1, WIDTH)
        np.matmul(own.reshape(-1, WIDTH).T, dq, out=g["A"])
        down = down + (dq @ p["A"].T).reshape(down.shape)
        dx[:, CONTEXT:] += down
        np.matmul(np.ones(len(dx), dx.dtype), dx.reshape(len(dx), -1), out=g["P"].reshape(-1))
        g["E"][:] = 0
        _add_rows(g["E"], inputs.reshape(-1), dx.reshape(-1, WIDTH))
        self.step += 1
        grad = self.grad
        self.m += 0.1 * (grad - self.m)
        self.v += 0.01 * (grad * grad - self.v)
        self.flat -= (self.rate / (1 - 0.9**self.step)) * self.m / (np.sqrt(self.v * (1 / (1 - 0.99**self.step))) + 1e-8)
        return loss


def packed(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)])


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    like, out, at = fresh(), {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out
