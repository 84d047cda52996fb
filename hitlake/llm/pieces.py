"""SentencePiece encoding and decoding with distinct sampled segmentations (operator 10).

A text becomes the lattice of all ways to write it in pieces of a given
SentencePiece vocabulary. Pieces have weights (``piece_weights``: a power of the
piece's rank, as BPE models hold ranks rather than probabilities), so paths have
probabilities. ``samples`` segmentations are drawn without replacement by Gumbel
top-k: the whole lattice gets one Gumbel value, a node hands its value to the child
that holds its maximum, and the rest of the node is a branch with a truncated
Gumbel value. A perturbed A-star search always takes the branch with the largest
value next; branch masses come from exact backward sums, so no path is scored
twice. All random numbers are hashes of (seed, row key, draw, place): a row gives
the same segmentations whatever its neighbours are.

``inclusion`` is the probability that the path exceeds the first value not drawn
(kappa), 1 - exp(-exp(log_prob - kappa)): the weight for estimates from samples
drawn without replacement; 1 where every segmentation was drawn. A long text's
segmentations are so many that it underflows: ``log_inclusion`` holds its logarithm,
which does not.

The lattice of each distinct chunk (a space and what follows it) is built once and
kept by the worker up to ``KEPT`` characters, all new chunks of a stretch of rows at a time. Chunks are
never cut: what is farther than ``LONGEST`` characters from a chunk's end is summed chunk by chunk, with the same result. Characters outside the vocabulary are byte pieces. Null and empty
texts give one row without pieces. Texts that hold U+2581 decode with a space in its
place, as with the library. Repeated rows get equal samples; a null key counts as
-1; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W

SPACE = "▁"
#: Characters (and steps of a walk) up to which all chunks are worked on together; beyond, each alone. At most 65534.
LONGEST = 2048
#: Characters of text that are worked on together: about 400 bytes of memory each.
STRETCH = 100_000
#: Characters of distinct chunks whose lattices a worker keeps (about 90 bytes each) before it starts anew.
KEPT = 500_000
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
_OTHER = 1 << 20  # a code of _OTHER + c stands for the byte pieces of character c
_MULT = np.uint64(0x9E3779B97F4A7C55)
_loaded: dict[tuple, Vocabulary] = {}
_lattices: dict[int, Lattice] = {}


def piece_weights(rank: np.ndarray, theta: float) -> np.ndarray:
    return -theta * np.log(10.0 + rank)


class Vocabulary:
    """Pieces of a model: hashes of all their prefixes in a probing table, log weights and bytes."""

    def __init__(self, path: str, theta: float = 0.5):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids, self.raw = np.zeros(256, "<u4"), [b""] * n
        nodes: dict[str, int] = {}
        for i in range(n):
            s = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(s[3:5], 16)] = i
                self.raw[i] = bytes([int(s[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.raw[i] = s.encode()
                for k in range(1, len(s)):
                    nodes.setdefault(s[:k], -1)
                nodes[s] = i
        self.longest = max(map(len, nodes))
        self.raw_size = np.array([len(x) for x in self.raw], "i8")
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.raw_flat = np.frombuffer(b"".join(self.raw), "u1")
        self.weight = piece_weights(np.arange(n, dtype="f8"), theta)
        self.byte_weight = float(piece_weights(np.float64(n), theta))
        size = 1 << (4 * len(nodes)).bit_length()
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.keys, self.values = np.zeros(size, "u8"), np.full(size, -1, "i4")
        for s, v in nodes.items():
            h = np.zeros(1, "u8")
            for c in s:
                h = h * _MULT + np.uint64(ord(c) + 1)
            at = int(W.mix(h)[0] >> self.shift)
            while self.keys[at]:
                at = (at + 1) % size
            self.keys[at], self.values[at] = h[0], v

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is a prefix of a piece, id of the piece or -1)."""
        at = (W.mix(h) >> self.shift).astype("i8")
        known, value = np.zeros(len(h), bool), np.full(len(h), -1, "i4")
        open_ = np.arange(len(h))
        while len(open_):
            k = self.keys[at[open_]]
            hit = k == h[open_]
            known[open_[hit]] = True
            value[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (k != 0)]
            at[open_] = (at[open_] + 1) % len(self.keys)
        return known, value


def vocabulary(path: str, theta: float) -> Vocabulary:
    if (path, theta) not in _loaded:
        _loaded[path, theta] = Vocabulary(path, theta)
    return _loaded[path, theta]


def chunks(text: str) -> list[str]:
    """The text as the model sees it: a space in front, spaces as U+2581, cut before spaces and at newlines."""
    if not text:
        return []
    if text[0] == " " or "  " in text or SPACE in text:
        return _CHUNK.findall(SPACE + text.replace(" ", SPACE))
    got: list[str] = []
    for i, line in enumerate(text.split("\n")):
        first, *rest = line.split(" ")
        if i == 0:
            got.append(SPACE + first)
        else:
            got.append("\n")
            if first:
                got.append(first)
        got += [SPACE + w for w in rest]
    return got


class Lattice:
    """Lattices of many chunks. A state is a character of a chunk; edges of a state lie together."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.names = vocab, {}
        self._held: dict[str, np.ndarray] = {}
        for name, kind in (("src", "i8"), ("step", "i4"), ("piece", "i4"), ("logp", "f8"), ("cdf", "f8"), ("end", "i8"), ("opens", "?"), ("start", "i8")):
            self._put(name, np.empty(0, kind))
        self._put("edge", np.zeros(1, "i8"))

    def _put(self, name: str, values: np.ndarray) -> None:
        """Append to an array that grows by doubling."""
        held, n = self._held.get(name, np.empty(0, values.dtype)), len(getattr(self, name, ()))
        if n + len(values) > len(held):
            wider = np.empty(2 * (n + len(values)), held.dtype)
            wider[:n] = held[:n]
            self._held[name] = held = wider
        held[n : n + len(values)] = values
        setattr(self, name, held[: n + len(values)])

    def words(self, text: str) -> np.ndarray:
        """Numbers of the text's chunks; new ones are named, and built by the next ``build``."""
        got = chunks(text)
        new = [c for c in dict.fromkeys(got) if c not in self.names]
        for c in new:
            self.names[c] = len(self.names)
        return np.fromiter(map(self.names.__getitem__, got), "i8", len(got))

    def build(self) -> None:
        """Lattices of the chunks named since the last call."""
        words = list(itertools.islice(reversed(self.names), len(self.names) - len(self.start)))[::-1]
        if words:
            self._add(words)

    def _add(self, words: list[str]) -> None:
        vocab, states, edges = self.vocab, len(self.end), len(self.src)
        cp = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "u4").astype("u8")
        size = np.array([len(w) for w in words], "i8")
        starts = np.concatenate([[0], np.cumsum(size)])
        end = np.repeat(starts[1:], size)
        at, h, found = np.arange(len(cp)), np.zeros(len(cp), "u8"), []
        single = np.zeros(len(cp), bool)
        for k in range(1, vocab.longest + 1):
            inside = at + k <= end[at]
            at, h = at[inside], h[inside]
            if not len(at):
                break
            h = h * _MULT + cp[at + k - 1] + np.uint64(1)
            known, piece = vocab.find(h)
            ok = piece >= 0
            found.append((at[ok], np.full(int(ok.sum()), k, "i4"), piece[ok]))
            if k == 1:
                single[at[ok]] = True
            at, h = at[known], h[known]
        bare = np.flatnonzero(~single)
        found.append((bare, np.ones(len(bare), "i4"), (_OTHER + cp[bare]).astype("i4")))
        src, step, piece = (np.concatenate([f[i] for f in found]) for i in range(3))
        other = piece >= _OTHER
        w = np.where(other, 0.0, vocab.weight[np.where(other, 0, piece)])
        c = piece[other] - _OTHER
        w[other] = vocab.byte_weight * (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))
        # edges by state, longest piece first: mostly the likeliest, so a draw is found at once
        fill = np.bincount(src, minlength=len(cp))
        edge = np.concatenate([[0], np.cumsum(fill)])
        nth, place = np.zeros(len(cp), "i4"), np.empty(len(src), "i8")
        sizes = [len(f[0]) for f in found]
        ends = np.cumsum(sizes)
        for z, n in reversed(list(zip(ends, sizes, strict=True))):  # a state has one edge of a length
            own = src[z - n : z]
            place[z - n : z] = edge[own] + nth[own]
            nth[own] += 1
        unsorted, (src, step, piece, v) = (src, step, piece, w), (np.empty(len(src), x.dtype) for x in (src, step, piece, w))
        src[place], step[place], piece[place], v[place] = unsorted
        to = src + step
        inner = to < end[src]
        # backward sums, by distance from the chunk's end
        dist = np.minimum(end[src] - src, LONGEST + 1).astype("u2")
        order = np.argsort(dist, kind="stable")
        s_, to_, v_, in_, d = src[order], to[order], v[order], inner[order], dist[order]
        beta = np.zeros(len(cp) + 1)
        cuts = np.searchsorted(d, np.arange(1, (min(int(d[-1]), LONGEST) if len(d) else 0) + 2))
        for a, z in zip(cuts, cuts[1:], strict=False):
            if a == z:
                continue
            x = v_[a:z] + np.where(in_[a:z], beta[to_[a:z]], 0.0)
            first = np.flatnonzero(np.diff(s_[a:z], prepend=-1))
            top = np.maximum.reduceat(x, first)
            owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, z - a)))
            beta[s_[a:z][first]] = top + np.log(np.add.reduceat(np.exp(x - top[owner]), first))
        for i in np.flatnonzero(size > LONGEST):
            self._sum_far(beta, int(starts[i]), int(starts[i + 1]), edge, step, v)
        logp = np.minimum(v + np.where(inner, beta[to], 0.0) - beta[src], 0.0)
        p = np.exp(logp)
        run = np.cumsum(p)
        run -= (run - p)[edge[src]]
        run[edge[1:] - 1] = 2.0
        opens = np.zeros(len(cp), bool)
        opens[starts[:-1]] = True
        for name, values in (
            ("src", src + states), ("step", step), ("piece", piece), ("logp", logp), ("cdf", run), ("end", end + states),
            ("opens", opens), ("start", starts[:-1] + states), ("edge", edge[1:] + edges),
        ):
            self._put(name, values)

    def _sum_far(self, beta: np.ndarray, first: int, end: int, edge: np.ndarray, step: np.ndarray, v: np.ndarray, stretch: int = 4096) -> None:
        """Backward sums of a chunk's states farther than LONGEST from its end, in stretches that hand on their sums."""
        for hi in range(end - LONGEST, first, -stretch):
            lo = max(first, hi - stretch)
            known = beta[lo : min(end, hi + self.vocab.longest)].tolist() + [0.0] * (self.vocab.longest + 1)
            e0, e1 = int(edge[lo]), int(edge[hi])
            at, steps, w = (edge[lo : hi + 1] - e0).tolist(), step[e0:e1].tolist(), v[e0:e1].tolist()
            for s in range(hi - lo - 1, -1, -1):
                x = [w[e] + known[s + steps[e]] for e in range(at[s], at[s + 1])]
                top = max(x)
                known[s] = top + math.log(sum([math.exp(y - top) for y in x]))
            beta[lo:hi] = known[: hi - lo]

    def _walk_on(self, state: int, stop: int, who: int, t: int, draw) -> np.ndarray:
        """Edges of one walk from its step t on."""
        out, edge, cdf, step = array("q"), self.edge, self.cdf, self.step
        while state < stop:
            for x in draw(np.full(LONGEST, who), np.arange(t, t + LONGEST)).tolist():
                e = int(edge[state])
                while cdf[e] <= x:
                    e += 1
                out.append(e)
                state += int(step[e])
                if state >= stop:
                    break
            t += LONGEST
        return np.frombuffer(out, "i8")

    def walk(self, state: np.ndarray, draw) -> tuple[np.ndarray, np.ndarray]:
        """Sample from each state to its chunk's end: edges in order, and how many for each state."""
        n = len(state)
        stop, who, parts, count = self.end[state], np.arange(n), [], np.zeros(n, "i8")
        t = 0
        while len(who) and t < LONGEST:
            e, x = self.edge[state[who]], draw(who, t)
            more = np.flatnonzero(self.cdf[e] <= x)
            while len(more):
                e[more] += 1
                more = more[self.cdf[e[more]] <= x[more]]
            parts.append((who, e))
            count[who] += 1
            state = state.copy() if t == 0 else state
            state[who] += self.step[e]
            who, t = who[state[who] < stop[who]], t + 1
        far = {w: self._walk_on(int(state[w]), int(stop[w]), w, t, draw) for w in who.tolist()}
        for w, e in far.items():
            count[w] += len(e)
        out = np.empty(int(count.sum()), "i8")
        off = np.cumsum(count) - count
        for t, (who, e) in enumerate(parts):
            out[off[who] + t] = e
        for w, e in far.items():
            out[off[w] + count[w] - len(e) : off[w] + count[w]] = e
        return out, count


def _hash(*keys) -> np.ndarray:
    h = np.array([0x243F6A8885A308D3], "u8")
    for k in keys:
        h = W.mix((h ^ np.asarray(k).astype("u8")) * _MULT + np.uint64(1))
    return h


def _to_unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype("f8") + 0.5) / float(1 << 53)


def _unit(*keys) -> np.ndarray:
    """Hash of integer keys, to (0, 1)."""
    return _to_unit(_hash(*keys))


def _truncated(phi: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values at locations phi, given they are below bound."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        return np.where(np.isfinite(phi), phi - np.log(-np.log(u) + np.exp(phi - bound)), -np.inf)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... n[i] numbers, one after another."""
    return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


def sample_texts(vocab: Vocabulary, texts: list[str], keys: np.ndarray, samples: int, seed: int) -> list[list[dict]]:
    """For each text up to ``samples`` distinct segmentations, in order of their perturbed values."""
    lat = _lattices.get(id(vocab))
    if lat is None or len(lat.end) > KEPT:
        lat = _lattices[id(vocab)] = Lattice(vocab)
    occ = [lat.words(t) for t in texts]
    lat.build()
    counts = np.array([len(o) for o in occ], "i8")
    out: list[list[dict]] = [[] for _ in texts]
    live = np.flatnonzero(counts)
    if not len(live):
        return out
    flat_words, word_off = np.concatenate(occ), np.cumsum(counts) - counts

    def path(docs, prefix, first, from_word, draw_no):
        """Complete paths of each document: prefix edges, then a walk from state ``first``
        (-1: none) to its word's end and through all words from ``from_word`` on."""
        inside, n = (first >= 0).astype("i8"), counts[docs] - from_word
        m = n + inside
        off = np.cumsum(m) - m
        s = np.empty(int(m.sum()), "i8")
        s[off[first >= 0]] = first[first >= 0]
        s[_ranges(off + inside, n)] = lat.start[flat_words[_ranges(word_off[docs] + from_word, n)]]
        base = _hash(seed, keys[np.repeat(docs, m)], draw_no, _ranges(from_word, m))
        e, steps = lat.walk(s, lambda who, t: _to_unit(W.mix(base[who] + (np.atleast_1d(t).astype("u8") * np.uint64(2) + np.uint64(1)) * _MULT)))
        ends = np.concatenate([[0], np.cumsum(steps)])
        tails = [e[a:z] for a, z in zip(ends[off].tolist(), ends[off + m].tolist(), strict=True)]
        return [t if p is None else np.concatenate([p, t]) for p, t in zip(prefix, tails, strict=True)]

    # pools[d]: branches as (path, values, log probability before each edge, edges taken by position)
    pools: dict[int, list] = {}

    def branches(docs, paths, starts, bounds, draw_no):
        """Values of the branches off the paths from their own first position on, all documents at once."""
        flat = np.concatenate(paths)
        n = np.array([len(p) for p in paths])
        off = np.cumsum(n) - n
        lp = lat.logp[flat]
        cum = np.cumsum(lp)
        before = cum - lp - np.repeat(cum[off] - lp[off], n)
        with np.errstate(divide="ignore"):
            phi = before + np.log(-np.expm1(np.minimum(lp, -1e-300)))
        src = lat.src[flat]
        phi[lat.edge[src + 1] - lat.edge[src] == 1] = -np.inf
        pos = np.arange(len(flat)) - np.repeat(off, n)
        v = np.full(len(flat), -np.inf)
        may = np.isfinite(phi) & (pos >= np.repeat(starts, n))
        doc = np.repeat(np.arange(len(docs)), n)[may]
        v[may] = _truncated(phi[may], bounds[doc], _unit(seed, keys[docs][doc], draw_no, pos[may], 1 << 41))
        for d, p, a, z in zip(docs.tolist(), paths, off.tolist(), (off + n).tolist(), strict=True):
            pools.setdefault(d, []).append([p, v[a:z], before[a:z], {}])
        return np.add.reduceat(lp, off).tolist()

    none = np.full(len(live), -1, "i8")
    g = -np.log(-np.log(_unit(seed, keys[live], 1 << 40)))
    tails = path(live, [None] * len(live), none, none * 0, 0)
    totals = branches(live, tails, none * 0, g, 0)
    for d, p, t, value in zip(live.tolist(), tails, totals, g.tolist(), strict=True):
        out[d].append({"edges": p, "log_prob": t, "value": value})
    for draw in range(1, samples + 1):
        tops = []
        for d in live.tolist():
            at = [int(b[1].argmax()) for b in pools[d]]
            r = max(range(len(at)), key=lambda i: pools[d][i][1][at[i]])
            value = float(pools[d][r][1][at[r]])
            if np.isfinite(value):
                tops.append((d, r, at[r], value))
                if draw == samples:
                    out[d][0]["kappa"] = value
        if draw == samples or not tops:
            break
        docs, places = (np.array([x[i] for x in tops], "i8") for i in (0, 2))
        bounds = np.array([x[3] for x in tops])
        picks = _unit(seed, keys[docs], draw, places, 1 << 42)
        prefix, first, word_at, phis = [], [], [], []
        for (d, r, t, _), u in zip(tops, picks.tolist(), strict=True):
            p, _, before, extra = pools[d][r]
            s = int(lat.src[p[t]])
            a, z = int(lat.edge[s]), int(lat.edge[s + 1])
            gone = {int(p[t]), *extra.get(t, ())}
            prob = np.exp(lat.logp[a:z])
            prob[[x - a for x in gone]] = 0
            mass = prob.sum()
            e = a + min(int(np.searchsorted(np.cumsum(prob), u * mass, side="right")), z - a - 1)
            while prob[e - a] == 0:
                e -= 1
            extra[t] = (*extra.get(t, ()), e)
            left = mass - prob[e - a]
            phis.append(before[t] + np.log(left) if z - a > len(gone) + 1 and left > 1e-300 else -np.inf)
            state = s + int(lat.step[e])
            prefix.append(np.append(p[:t], e))
            first.append(state if state < lat.end[s] else -1)
            word_at.append(int(np.count_nonzero(lat.opens[lat.src[p[: t + 1]]])))
        rest = _truncated(np.array(phis), bounds, _unit(seed, keys[docs], draw, places, 1 << 43))
        for (d, r, t, _), value in zip(tops, rest.tolist(), strict=True):
            pools[d][r][1][t] = value
        tails = path(docs, prefix, np.array(first, "i8"), np.array(word_at, "i8"), draw)
        totals = branches(docs, tails, places + 1, bounds, draw)
        for d, p, t, value in zip(docs.tolist(), tails, totals, bounds.tolist(), strict=True):
            out[d].append({"edges": p, "log_prob": t, "value": value})
    for d in live.tolist():
        kappa = out[d][0].get("kappa", -np.inf)
        for o in out[d]:
            o["ids"] = piece_ids(vocab, lat.piece[o.pop("edges")])
            o["log_inclusion"] = log_inclusion(o["log_prob"], kappa) if np.isfinite(kappa) else 0.0
            o["inclusion"] = math.exp(o["log_inclusion"])
    return out


def log_inclusion(log_prob: float, kappa: float) -> float:
    """log(1 - exp(-exp(log_prob - kappa))), exact also where the exponential underflows."""
    x = log_prob - kappa
    if x > 5:
        return -math.exp(-math.exp(min(x, 700.0)))
    return x if x < -30 else math.log(-math.expm1(-math.exp(x)))


def piece_ids(vocab: Vocabulary, codes: np.ndarray) -> np.ndarray:
    """Ids of edges' pieces; a character without a piece becomes the pieces of its bytes."""
    other = codes >= _OTHER
    if not other.any():
        return codes.astype("<u4")
    c = codes[other] - _OTHER
    n = np.ones(len(codes), "i8")
    n[other] += (c >= 0x80).astype("i8") + (c >= 0x800) + (c >= 0x10000)
    ids = np.repeat(codes, n).astype("<u4")
    raw = c.astype("<u4").tobytes().decode("utf-32-le").encode()
    ids[np.repeat(other, n)] = vocab.byte_ids[np.frombuffer(raw, "u1")]
    return ids


def decode(vocab: Vocabulary, ids: np.ndarray) -> str:
    """The text of piece ids."""
    at = _ranges(vocab.raw_at[ids], vocab.raw_size[ids])
    text = vocab.raw_flat[at].tobytes().decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


def _model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def sample_segmentations(docs: DataFrame, model: str | None = None, samples: int = 2, seed: int = 5, theta: float = 0.5) -> DataFrame:
    """A row per document and segmentation.

    (doc_id, sample, n_pieces, ids binary little-endian uint32, log_prob, inclusion,
    log_inclusion, decoded): whole texts, in the tasks that read them; no shuffle.
    """
    model = model or _model()
    names = ["doc_id", "sample", "n_pieces", "ids", "log_prob", "inclusion", "log_inclusion", "decoded"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]

    def encode(batches):
        vocab = vocabulary(model, theta)

        def rows(ids: list, texts: list[str]):
            keys = np.array([-1 if i is None else i for i in ids], "i8").view("u8")
            cols: list[list] = [[] for _ in names]
            for i, t, got in zip(ids, texts, sample_texts(vocab, texts, keys, samples, seed), strict=True):
                for k, o in enumerate(got or [{"ids": np.empty(0, "<u4"), "log_prob": 0.0, "inclusion": 1.0, "log_inclusion": 0.0}]):
                    for c, x in zip(cols, (i, k, len(o["ids"]), o["ids"].tobytes(), o["log_prob"], o["inclusion"], o["log_inclusion"], decode(vocab, o["ids"]) == t), strict=True):
                        c.append(x)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for b in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py() or ""
                ids.append(i), texts.append(text)
                size += len(text)
                if size >= STRETCH:
                    yield rows(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield rows(ids, texts)

    return docs.select("doc_id", "text").mapInArrow(
        encode, "doc_id long, sample int, n_pieces long, ids binary, log_prob double, inclusion double, log_inclusion double, decoded boolean"
    )


def decode_pieces(rows: DataFrame, model: str | None = None) -> DataFrame:
    """``rows`` (ids: little-endian uint32, as ``sample_segmentations`` gives them) with the decoded text in a column ``text``.

    Null ids give a null text, no ids an empty one; a column of that name is replaced.
    """
    at = model or _model()

    def decoded(batches):
        vocab = vocabulary(at, 0.5)
        for b in batches:
            texts = [None if x is None else decode(vocab, np.frombuffer(x, "<u4")) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*b.schema.names[:-1], "text"])

    kept = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c.lower() != "text"])
    return kept.withColumn("text", F.col("ids")).mapInArrow(decoded, kept.withColumn("text", F.lit(None).cast("string")).schema)


def op10_pieces(docs: DataFrame) -> DataFrame:
    got = sample_segmentations(docs)
    return got.select("doc_id", "sample", "n_pieces", F.crc32("ids").alias("ids_crc32"), "log_prob", "inclusion", "log_inclusion", "decoded")
