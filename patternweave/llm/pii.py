"""Personal data: exact base patterns and a character tagger.

The tagger is a bidirectional LSTM over characters with a linear-chain CRF,
trained in numpy from generated texts with labelled spans.  Every text is cut
into overlapping windows and each window is scored; where windows overlap,
their scores are blended by the distance to the windows' ends, and the best
path over the whole text reconciles them.  That path is only sought where a
bound on its gain leaves it open whether there is a span.

Base spans always stay; a span of the tagger is added if it overlaps none and
holds what its kind must (``plausible``; a secret has a digit and 12 characters).
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

KINDS = ("email", "ip", "card", "phone", "secret")
TAGS = 1 + 2 * len(KINDS)
#: Characters of a window, and from one window's start to the next; ``TAUGHT``: of those that it is trained on.
WINDOW, STRIDE = 256, 224
TAUGHT, HIDDEN, BATCH, EPOCHS, EXAMPLES, RATE = 96, 12, 64, 6, 3200, 0.012
#: Symbols: ASCII characters, any other letter, anything else.
SYMBOLS = 130

_CLASS = r"[A-Za-z0-9._%+-]"
_LOCAL_END = re.compile(_CLASS + r"+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if k % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, in time linear in the text."""
    out = []
    upto, at = 0, text.find("@")
    while at >= 0:
        # the characters before an @ hold none, so no stretch is read twice
        start = at
        while start > upto and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((0, start, m.end()))
            upto = m.end()
        at = text.find("@", at + 1)
    if any(c in text for c in "0123456789"):
        # a match from within a run of digits would succeed from its start too
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


# --- the tagger


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, points, np.where(points < 0x2000, 128, 129)).astype(np.uint8)


def examples(count: int, seed: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Generated windows: symbols and tags."""
    r = np.random.default_rng(seed)
    pick = lambda s: s[int(r.integers(len(s)))]
    digits = lambda n: "".join(str(x) for x in r.integers(0, 10, n))
    some = lambda s, n: "".join(pick(s) for _ in range(n))
    low, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    parts = ["".join(pick("bcdfghklmnprstvwzäéñ") + pick("aeiouüó") for _ in range(1)) for _ in range(60)]

    def word() -> str:
        w = "".join(pick(parts) for _ in range(int(r.integers(1, 4))))
        w = w.upper() if r.random() < 0.05 else w.capitalize() if r.random() < 0.15 else w
        return w + (pick([".", ",", "!!", " |", "###", ":", "?"]) if r.random() < 0.2 else "")

    def decoy() -> str:
        return pick([f"version {r.integers(1, 9)}.{r.integers(0, 9)}", f"{r.integers(1, 9)}.0.", f"{r.integers(1900, 2030)}-{r.integers(1, 13):02d}-{r.integers(1, 29):02d}", digits(int(r.integers(1, 8))), f"@{some(low, 5)}", f"{digits(2)}%", f"v{r.integers(1, 20)}", f"{digits(3)},{digits(3)}", "a @ b", f"{digits(2)}:{digits(2)}", f"({digits(1)})", f"+{digits(1)}", f"{some(low, 3)}{digits(2)}", f"4.0", f"section {digits(2)}"])

    def found(k: int) -> str:
        if k == 0:
            name = some(low, int(r.integers(3, 10))) + pick(["", ".", "_", "-", "+"]) + pick([digits(2), some(low, 4), ""])
            return f"{name}@{pick(['mail' + digits(1), some(low, 6), 'corp-' + some(low, 3)])}.{pick(['example.com', 'com', 'org', 'de', 'co.uk', 'net', 'io'])}"
        if k == 1:
            return ".".join(str(x) for x in r.integers(1, 256, 4))
        if k == 2:
            n = "4" + digits(int(pick([15, 15, 15, 18])))
            sep = pick(["", "", " ", "-"])
            return sep.join(n[i : i + 4] for i in range(0, len(n), 4))
        if k == 3:
            return pick([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}", f"+{digits(11)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"00{digits(2)} {digits(3)} {digits(6)}", f"+{digits(2)}-{digits(4)}-{digits(5)}"])
        return pick(["AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), some(hexa, 18), some(hexa, 40), "ghp_" + some(low.upper() + low + "0123456789", 30), "sk-" + some(low + "0123456789", 24)])

    xs, ys = np.full((count, TAUGHT), 32), np.zeros((count, TAUGHT), np.int64)
    for n in range(count):
        text, tags = "", []
        for _ in range(40):
            if len(text) > TAUGHT + 30:
                break
            u = r.random()
            lead = " " if r.random() < 0.9 else "\n"
            if u < 0.12:
                k = int(r.integers(len(KINDS)))
                before = pick(["password=", 'token = "', "key: ", "api_key=", ""]) if k == 4 else pick(["", "", "", "<", "tel:", "("])
                s = found(k)
                after = '"' if before.endswith('"') else pick(["", "", "", ".", ",", ")", "\n"])
                text += lead + before + s + after
                tags += [0] * (1 + len(before)) + [1 + 2 * k] + [2 + 2 * k] * (len(s) - 1) + [0] * len(after)
            else:
                s = decoy() if u < 0.24 else word()
                text += lead + s
                tags += [0] * (1 + len(s))
        at = int(r.integers(0, max(1, len(text) - TAUGHT)))
        x = symbols(text[at : at + TAUGHT])
        xs[n, : len(x)] = x
        ys[n, : len(x)] = tags[at : at + len(x)]
    return xs, ys


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Tagger:
    """Parameters ``p``: for each direction input rows ``x`` (a row a symbol) and recurrent ``h``; ``out``, ``bias``; CRF ``move``, ``begin``, ``finish``."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {f"{d}{k}": (r.standard_normal(s) * a).astype(np.float32) for d in "fb" for k, s, a in (("x", (SYMBOLS, 4 * h), 0.3), ("h", (h, 4 * h), 0.25))}
        for d in "fb":
            self.p[d + "x"][:, h : 2 * h] += 1.0  # remember at first
        self.p |= {"out": (r.standard_normal((2 * h, TAGS)) * 0.2).astype(np.float32), "bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32), "begin": np.zeros(TAGS, np.float32), "finish": np.zeros(TAGS, np.float32)}

    def _run(self, d: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (steps, rows, HIDDEN) of one direction; x: (steps, rows)."""
        wx, wh, h = self.p[d + "x"], self.p[d + "h"], HIDDEN
        steps, n = x.shape
        out = np.empty((steps, n, h), np.float32)
        s, c, kept = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = wx[x[t]] + s @ wh
            g = _sigmoid(z[:, : 3 * h])
            u = np.tanh(z[:, 3 * h :])
            old, was = c, s
            c = g[:, h : 2 * h] * old + g[:, :h] * u
            tc = np.tanh(c)
            s = g[:, 2 * h :] * tc
            out[t] = s
            if keep:
                kept.append((t, g, u, old, tc, was))
        return out, kept

    def _states(self, d: str, x: np.ndarray) -> np.ndarray:
        """The hidden states of ``_run`` as (steps, HIDDEN, rows), in place: gates are whole blocks of memory.

        A sigmoid is half a tanh of half its argument, so one tanh serves all gates.
        """
        h, n = HIDDEN, x.shape[1]
        half = np.concatenate((np.full(3 * h, 0.5, np.float32), np.ones(h, np.float32)))
        wx, wh = np.ascontiguousarray((self.p[d + "x"] * half).T), np.ascontiguousarray((self.p[d + "h"] * half).T)
        out, c, z = np.empty((len(x), h, n), np.float32), np.zeros((h, n), np.float32), np.empty((4 * h, n), np.float32)
        s, more, back = np.zeros((h, n), np.float32), np.empty((h, n), np.float32), np.empty((4 * h, n), np.float32)
        g, i, forget, o, u = z[: 3 * h], z[:h], z[h : 2 * h], z[2 * h : 3 * h], z[3 * h :]
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            np.take(wx, x[t], axis=1, out=z, mode="clip")
            z += np.matmul(wh, s, out=back)
            np.tanh(z, out=z)
            g *= 0.5
            g += 0.5
            c *= forget
            c += np.multiply(i, u, out=more)
            s = np.multiply(o, np.tanh(c, out=more), out=out[t])
        return out

    def _scores(self, x: np.ndarray) -> np.ndarray:
        """(steps, TAGS, rows) of windows of symbols (rows, steps)."""
        xt, h, p = np.ascontiguousarray(x.T).astype(np.intp), HIDDEN, self.p
        e = np.matmul(np.ascontiguousarray(p["out"][:h].T), self._states("f", xt))
        e += np.matmul(np.ascontiguousarray(p["out"][h:].T), self._states("b", xt))
        e += p["bias"][:, None]
        return e

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores (rows, steps, TAGS) of windows of symbols (rows, steps)."""
        return np.ascontiguousarray(self._scores(x).transpose(2, 0, 1))

    def gains(self, x: np.ndarray) -> np.ndarray:
        """(rows, steps): by how much the best tag of a span scores above none."""
        e = self._scores(x)
        return np.ascontiguousarray((e[:, 1:].max(1) - e[:, 0]).T)

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of a batch and its gradients."""
        p, h, xt, yt = self.p, HIDDEN, x.T, y.T
        steps, n = xt.shape
        (f, keep_f), (b, keep_b) = self._run("f", xt, True), self._run("b", xt, True)
        both = np.concatenate((f, b), axis=2)
        e = (both @ p["out"] + p["bias"]).astype(np.float64)
        move, rows = p["move"].astype(np.float64), np.arange(n)

        # sums over tags in the exponential domain: a row's greatest score is taken out, then one matrix product
        hop = np.exp(move)

        def summed(a: np.ndarray, by: np.ndarray) -> np.ndarray:
            top = a.max(1, keepdims=True)
            return np.log(np.exp(a - top) @ by) + top

        alpha, beta = np.empty_like(e), np.empty_like(e)
        alpha[0] = p["begin"] + e[0]
        for t in range(1, steps):
            alpha[t] = e[t] + summed(alpha[t - 1], hop)
        beta[-1] = p["finish"]
        for t in range(steps - 2, -1, -1):
            beta[t] = summed(e[t + 1] + beta[t + 1], hop.T)
        z = summed(alpha[-1] + p["finish"], np.ones((TAGS, 1)))[:, 0]
        gold = p["begin"][yt[0]] + p["finish"][yt[-1]] + sum(e[t][rows, yt[t]] for t in range(steps)) + sum(move[yt[t - 1], yt[t]] for t in range(1, steps))
        marginal = np.exp(alpha + beta - z[:, None])
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        top = alpha.max(2, keepdims=True)
        ahead, after = np.exp(alpha - top)[:-1], np.exp((e + beta - z[:, None])[1:] + top[:-1])
        pair = np.einsum("tni,tnj->ij", ahead, after) * hop
        np.add.at(pair, (yt[:-1].ravel(), yt[1:].ravel()), -1)
        grads["move"] = (pair / n).astype(np.float32)
        de = marginal
        np.add.at(de, (np.repeat(np.arange(steps), n), np.tile(rows, steps), yt.ravel()), -1)
        grads["begin"], grads["finish"] = (de[0].sum(0) / n).astype(np.float32), ((np.exp(alpha[-1] + p["finish"] - z[:, None]).sum(0) - np.bincount(yt[-1], minlength=TAGS)) / n).astype(np.float32)
        de = (de / n).astype(np.float32)
        grads["out"], grads["bias"] = np.einsum("tnh,tnk->hk", both, de), de.sum((0, 1))
        dboth = de @ p["out"].T
        for d, kept, part in (("f", keep_f, dboth[:, :, :h]), ("b", keep_b, dboth[:, :, h:])):
            ds, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            gx, gh, wh = grads[d + "x"], grads[d + "h"], p[d + "h"]
            for t, g, u, old, tc, was in reversed(kept):
                ds = ds + part[t]
                i, forget, o = g[:, :h], g[:, h : 2 * h], g[:, 2 * h :]
                dc = dc + ds * o * (1 - tc**2)
                dz = np.concatenate((dc * u * i * (1 - i), dc * old * forget * (1 - forget), ds * tc * o * (1 - o), dc * i * (1 - u**2)), axis=1)
                np.add.at(gx, xt[t], dz)
                gh += was.T @ dz
                ds, dc = dz @ wh.T, dc * forget
        return float((z - gold).mean()), grads

    def bounds(self) -> tuple[float, float]:
        """(step, need): moves of a path that leaves "no span" for n characters and comes back sum to ``n * step - need`` at most, against staying.

        ``step`` is just so great that no cycle of moves gains more; then the
        best sum of moves up to each tag is finite and found by relaxation.
        """
        p = {k: self.p[k].astype(np.float64) for k in ("move", "begin", "finish")}
        none = p["move"][0, 0]
        move = p["move"][1:, 1:] - none
        enter = np.maximum(p["move"][0, 1:] - none, p["begin"][1:] - p["begin"][0])
        leave = np.maximum(p["move"][1:, 0] - none, p["finish"][1:] - p["finish"][0])
        step = float(move.diagonal().max())
        while True:
            best = enter - step
            for _ in range(2 * TAGS):
                more = np.maximum(best, (best[:, None] + move - step).max(0))
                if np.allclose(more, best, atol=1e-12):
                    # a little is left for rounding in single precision
                    return step + 1e-4, -float((best + leave).max()) - 1e-2
                best = more
            step += 0.02 + 0.02 * abs(step)

    def decode(self, e: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Best tags of stretches (rows, steps, TAGS), of ``lengths`` steps each."""
        n, steps, _ = e.shape
        move = self.p["move"]
        # in double precision: over long stretches sums in single precision lose the small differences
        best = (self.p["begin"] + e[:, 0]).astype(np.float64)
        back = np.zeros((steps, n, TAGS), np.int8)
        final = best + self.p["finish"]
        for t in range(1, steps):
            m = best[:, :, None] + move
            back[t] = m.argmax(1)
            best = np.take_along_axis(m, back[t][:, None, :].astype(np.int64), 1)[:, 0] + e[:, t]
            ends = lengths == t + 1
            final[ends] = best[ends] + self.p["finish"]
        out = []
        for k in range(n):
            tag, path = int(final[k].argmax()), np.zeros(lengths[k], np.int64)
            for t in range(lengths[k] - 1, -1, -1):
                path[t] = tag
                tag = int(back[t, k, tag])
            out.append(path)
        return out


@lru_cache(maxsize=1)
def trained() -> Tagger:
    """The tagger, trained from generated spans; the same in every run."""
    x, y = examples(EXAMPLES)
    tagger, r = Tagger(), np.random.default_rng(3)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in tagger.p.items()}
    step, total = 0, EPOCHS * (len(x) // BATCH)
    for _ in range(EPOCHS):
        order = r.permutation(len(x))
        for k in range(0, len(x) - BATCH + 1, BATCH):
            _, grads = tagger.step(x[order[k : k + BATCH]], y[order[k : k + BATCH]])
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for name, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m, v = moments[name]
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
                moments[name] = (m, v)
                tagger.p[name] = (tagger.p[name] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return tagger


#: Weight of a character's score by its place in a window: less near the ends.
_BLEND = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float32)
#: Windows that pass through the network at once.
_ROWS = 512


class Layout:
    """Texts that stand one after the other, each from a whole stride on with a stride to spare, and their windows.

    The scores of a window are so added to two rows of strides.
    """

    def __init__(self, x: np.ndarray, ends: np.ndarray):
        size = np.diff(ends)
        count = np.where(size > 0, np.maximum(1, -(-(size - (WINDOW - STRIDE)) // STRIDE)), 0)
        row = np.cumsum(count + 1) - (count + 1)
        self.rows = int((count + 1).sum()) + 1
        #: whether a window begins with each row, and where each character is laid
        self.real = np.bincount(row + count, minlength=self.rows) == 0
        self.real[-1] = False
        self.place = np.arange(len(x)) + np.repeat(STRIDE * row - ends[:-1], size)
        laid = np.full((self.rows + 1) * STRIDE, 32, x.dtype)
        laid[self.place] = x
        self.windows = np.lib.stride_tricks.sliding_window_view(laid, WINDOW)[::STRIDE]

    def blend(self, wanted: np.ndarray, score, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Blended ``score``s of the rows ``wanted``, and each row's number among them (or -1); all windows over these rows are scored."""
        number = np.full(self.rows + 1, -1)
        number[wanted] = np.arange(len(wanted))
        begin = np.zeros(self.rows, bool)
        begin[wanted] = True
        begin[np.maximum(wanted - 1, 0)] = True
        own = np.flatnonzero(begin & self.real)
        lap, w = WINDOW - STRIDE, _BLEND.reshape(-1, *(1 for _ in shape))
        sums, weight = np.zeros((len(wanted), STRIDE, *shape), np.float32), np.zeros((len(wanted), STRIDE, *(1 for _ in shape)), np.float32)
        for k in range(0, len(own), _ROWS):
            at = own[k : k + _ROWS]
            e = score(self.windows[at])
            e *= w
            for to, part, upto in ((number[at], slice(0, STRIDE), STRIDE), (number[at + 1], slice(STRIDE, None), lap)):
                some = to >= 0
                sums[to[some], :upto] += e[some, part]
                weight[to[some], :upto] += w[part]
        sums /= np.maximum(weight, 1e-9)
        return sums, number


def doubtful(gain: np.ndarray, ends: np.ndarray, tagger: Tagger) -> list[tuple[int, int, int]]:
    """(text, first, end) of the stretches outside which no best path has a span.

    An excursion of a path from "no span" gains at most the sum of its
    characters' ``gain`` (of the best tag over none, or more), less what it
    ``need``s (``bounds``).  Of a paying
    excursion cut in two, one part sums to over half of that; a character with
    no such run before or after it is in no paying excursion.
    """
    step, need = tagger.bounds()
    gain = gain.astype(np.float64) + step
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    # sums run on over the texts; each is lowered by more than any gain, so that no least sum reaches over an end
    fall = (np.abs(gain).sum() + 1) * owner
    before = np.concatenate(([0.0], np.cumsum(gain)))
    upto = before[1:] - fall - np.minimum.accumulate(before[:-1] - fall)
    after = np.maximum.accumulate((before[1:] - fall)[::-1])[::-1] - (before[:-1] - fall)
    half = min(need, need / 2)
    hot = upto > half
    hot[:-1] |= (after[1:] > half) & (owner[1:] == owner[:-1])
    near = np.flatnonzero(hot)
    if not len(near):
        return []
    new = np.ones(len(near), bool)
    new[1:] = (np.diff(near) > 1) | (owner[near[1:]] != owner[near[:-1]])
    edge = np.flatnonzero(new)
    paying = np.maximum.reduceat(upto[near], edge) > need
    first, last = near[edge], near[np.concatenate((edge[1:], [len(near)])) - 1]
    return [(int(owner[a]), int(a), int(b) + 1) for a, b in zip(first[paying], last[paying], strict=True)]


#: Characters of a very long text that are scored at once, and those around a part that it is scored with; whole strides.
PART, MARGIN = STRIDE << 12, STRIDE << 4


def tag(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) of the tagger's spans in each text.

    A text over ``PART`` characters is scored in parts with a margin on either
    side; a span belongs to the part in which it starts.
    """
    parts = [(k, a) for k, t in enumerate(texts) for a in range(0, len(t), PART)]
    begin = [max(0, a - MARGIN) for _, a in parts]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    at = 0
    while at < len(parts):
        # parts of about PART characters in all go together
        to, size = at, 0
        while to < len(parts) and (to == at or size + len(texts[parts[to][0]]) <= PART):
            size += len(texts[parts[to][0]])
            to += 1
        cut = [texts[k][b : a + PART + MARGIN] for (k, a), b in zip(parts[at:to], begin[at:to], strict=True)]
        for (k, a), b, spans in zip(parts[at:to], begin[at:to], _tagged(cut, tagger), strict=True):
            found[k] += [(kind, b + x, b + y) for kind, x, y in spans if a <= b + x < a + PART]
        at = to
    return [sorted(s for s in spans if plausible(s[0], texts[k][s[1] : s[2]])) for k, spans in enumerate(found)]


def _tagged(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ends = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    if not ends[-1]:
        return found
    x = symbols("".join(texts))
    laid = Layout(x, ends)
    # every window is scored; the blended gain of the best tags bounds the gain of the best blended tag
    gain = laid.blend(np.arange(laid.rows), tagger.gains, ())[0].reshape(-1)[laid.place]
    # every kind holds a digit or an @, so a stretch with neither has nothing that would be kept
    anchors = np.concatenate(([0], np.cumsum((x == 64) | ((x >= 48) & (x <= 57)))))
    stretches = sorted((s for s in doubtful(gain, ends, tagger) if anchors[s[2]] > anchors[s[1]]), key=lambda s: s[2] - s[1])
    # the scores of all tags, where they are looked at
    mark = np.zeros(laid.rows, bool)
    for _, a, b in stretches:
        mark[laid.place[max(a - 1, 0)] // STRIDE : laid.place[min(b, len(x) - 1)] // STRIDE + 1] = True
    scores, number = laid.blend(np.flatnonzero(mark), tagger.emissions, (TAGS,))
    k = 0
    while k < len(stretches):
        # stretches of like length go together, within a bound on the array; beside each stands a character without a span
        j = k + 1
        while j < len(stretches) and (stretches[j][2] - stretches[j][1]) <= 1.3 * (stretches[k][2] - stretches[k][1]) + 8 and (j - k) * (stretches[j][2] - stretches[j][1]) < 1 << 15:
            j += 1
        group = [(o, a, b, int(a > ends[o]), int(b < ends[o + 1])) for o, a, b in stretches[k:j]]
        lengths = np.array([b - a + left + right for _, a, b, left, right in group])
        padded = np.zeros((len(group), lengths.max(), TAGS), np.float32)
        for i, (_, a, b, left, right) in enumerate(group):
            at = laid.place[a - left : b + right]
            padded[i, : lengths[i]] = scores[number[at // STRIDE], at % STRIDE]
            if left:
                padded[i, 0, 1:] = -1e6
            if right:
                padded[i, lengths[i] - 1, 1:] = -1e6
        for (o, a, _, left, _), path in zip(group, tagger.decode(padded, lengths), strict=True):
            found[o] += [(kind, int(a - left - ends[o]) + x, int(a - left - ends[o]) + y) for kind, x, y in spans_of(path)]
        k = j
    return found


def spans_of(path: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of a path of tags: 0 none, then for each kind its first character and others."""
    inside = np.concatenate(([0], path, [0]))
    kind = (inside + 1) // 2
    edge = np.flatnonzero((kind[1:] != kind[:-1]) | ((inside[1:] % 2 == 1) & (inside[1:] > 0)))
    return [(int(kind[a + 1]) - 1, a, b) for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(path)][: len(edge)], strict=True) if a < len(path) and kind[a + 1]]


def plausible(kind: int, found: str) -> bool:
    """What a tagged span has to hold at least: an address its @, a card its checksum, and so on."""
    digits = "".join(c for c in found if c in "0123456789")
    if kind == 0:
        local, at, domain = found.rpartition("@")
        return bool(local and at and "." in domain.strip("."))
    if kind == 1:
        parts = found.split(".")
        return len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 8 <= len(digits) <= 15 and (found[0] in "+(" or found.startswith("00") or any(c in " -" for c in found))
    return bool(digits) and len(found) >= 12 and not digits == found


def together(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and those of ``more`` that overlap none of them, by kind and start."""
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    ends = list(np.maximum.accumulate([b for _, b in taken])) if taken else []
    out = list(base)
    for k, a, b in more:
        i = int(np.searchsorted(starts, b))
        if not i or ends[i - 1] <= a:
            out.append((k, a, b))
    return sorted(out)


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, base and spans (arrays of kind, start, end; code points, end exclusive).

    ``base`` has the exact patterns, ``spans`` these and the tagger's.  A null
    text counts as empty: no spans.  Rows stay one by one, repeated or null ids
    included; other columns are left out, so their names can't clash; an empty
    table gives none.  Very long texts are scored in parts, with the same result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = "array<struct<kind:string,start:long,end:long>>"
    schema = runtime.added(rows.select("doc_id").schema, f"base {kind}, spans {kind}")
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    sent = docs.sparkSession.sparkContext.broadcast(trained())

    def make():
        tagger = sent.value

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = [x or "" for x in part.column(1).to_pylist()]
            base = [sorted(base_spans(t)) for t in texts]
            spans = [together(b, m) for b, m in zip(base, tag(texts, tagger), strict=True)]
            named = [[[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in row] for row in x] for x in (base, spans)]
            return pa.record_batch([part.column(0), *(pa.array(x, arrow) for x in named)], names=schema.names)

        return run

    return runtime.map_slices(rows, "text", schema, make, limit=PART)
