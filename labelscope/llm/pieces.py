"""SentencePiece encoding by sampling without replacement, and decoding.

A text's pieces form a lattice; a path is a segmentation, its probability the normalised product
of its pieces' weights. Gumbel top-k draws k distinct paths: an A-star search over prefixes keeps
for every unexplored branch the largest perturbed log probability below it, truncated by its
parent's (the search's bound is exact, so paths come out in falling order). Branches that leave
one path at one place are held as a group and split only when the search takes one.

The vocabulary's pieces never cross a space mark, so the lattice is a chain of small lattices,
one per run of marks and the word behind it, and what is left of a path after a branch is drawn
word by word. Words of a batch with equal suffixes share the nodes of those. All draws are counters hashed with the row's key: results do not depend on how
rows are batched. Rows are searched side by side, a path of each in turn: what is drawn for their paths is
drawn at once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import map_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, SEED, SHARPNESS = 2, 17, 0.5
#: Rows whose words share lattices, and words of their texts that are searched side by side, so few that what is drawn for them stays in a processor's cache.
ROWS, TURN_WORDS = 1000, 1 << 16
#: Suffixes of a length that so few words reach are not compared with each other.
FEW = 64
MARK = "▁"


class Vocabulary:
    """Pieces with log weights, and their trie as a hash table of (state, character) pairs."""

    def __init__(self, model: str = MODEL, sharpness: float = SHARPNESS) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.byte, self.text = [0] * 256, [b""] * n
        total = math.log(sum(1 / (i + 10) for i in range(n)))
        # the file orders pieces by merge, not by probability: weights follow the rank
        self.weight = np.array([-sharpness * (math.log(i + 10) + total) for i in range(n + 1)])
        states, piece = {"": 0}, [-1]
        moves: list[tuple[int, str, int]] = []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.text[i] = bytes([int(p[3:5], 16)])
            elif not sp.is_control(i) and not sp.is_unknown(i):
                self.text[i] = p.encode()
                for k in range(1, len(p) + 1):
                    if p[:k] not in states:
                        states[p[:k]] = len(piece)
                        moves.append((states[p[: k - 1]], p[k - 1], len(piece)))
                        piece.append(-1)
                piece[states[p]] = i
        #: The bytes of each piece, marks as spaces, for decoding.
        self.plain = pa.array([t.replace(MARK.encode(), b" ") for t in self.text], pa.large_binary())
        self.piece = np.array(piece, np.int32)
        self.longest = max(map(len, states))
        self.bits = 2 + len(moves).bit_length()
        self.slot, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        todo = np.array([(a << 21) | ord(c) for a, c, _ in moves])
        to = np.array([b for *_, b in moves], np.int32)
        at = self._place(todo)
        while len(todo):
            free = np.flatnonzero(self.slot[at] < 0)
            self.slot[at[free]], self.to[at[free]] = todo[free], to[free]
            again = self.slot[at] != todo
            todo, to, at = todo[again], to[again], (at[again] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, states: np.ndarray, characters: np.ndarray) -> np.ndarray:
        """The next states, 0 where no piece goes on."""
        keys = states.astype(np.int64) << 21 | characters
        at = self._place(keys)
        slot = self.slot[at]
        out = np.where(slot == keys, self.to[at], 0)
        left = np.flatnonzero((slot != keys) & (slot >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            slot = self.slot[at[left]]
            out[left] = np.where(slot == keys[left], self.to[at[left]], 0)
            left = left[(slot != keys[left]) & (slot >= 0)]
        return out


def _suffixes(chars: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """A node for each different suffix of the words, from 1 and from short to long; 0 is the empty one.

    Of a length that at most ``FEW`` words reach, each word's suffix is a node of its own, equal or not. Words are given by their characters in a row and the length of each. Returns each word's node, the next shorter suffix and
    first character of each node, and the first node of each length, with one more behind the last.
    """
    order = np.argsort(-sizes, kind="stable")  # words that reach a length are the first ones
    last, most = np.cumsum(sizes)[order], int(sizes.max())
    reach = len(sizes) - np.cumsum(np.bincount(sizes, minlength=most + 1))
    node, shorter, heads, bounds = np.zeros(len(sizes), np.int64), [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [1]
    for length, m in enumerate(reach[:most].tolist(), 1):
        keys, number = node[:m] << 21 | chars[last[:m] - length], np.arange(m)
        if m > FEW:
            met = pa.array(keys).dictionary_encode()
            keys, number = met.dictionary.to_numpy(), met.indices.to_numpy()
        node[:m] = number
        node[:m] += bounds[-1]
        shorter.append(keys >> 21)
        heads.append(keys & (1 << 21) - 1)
        bounds.append(bounds[-1] + len(keys))
    start = np.empty(len(sizes), np.int64)
    start[order] = node
    return start, np.concatenate(shorter), np.concatenate(heads), bounds


class Lattices:
    """The lattices of the distinct words of a batch: a node per suffix, branches with normalised probabilities.

    What may follow a place in a word depends on the rest of the word alone, so words share the nodes of their equal
    suffixes. Node 0 is the end of every word.
    """

    def __init__(self, vocabulary: Vocabulary, chars: np.ndarray, sizes: np.ndarray) -> None:
        self.byte, self.bytes_a = vocabulary.byte, np.array(vocabulary.byte, np.int32)
        #: First node of each word.
        self.start, shorter, heads, bounds = _suffixes(chars, sizes)
        n = len(heads)
        found, state, where, at = [], np.zeros(n - 1, np.int32), np.arange(1, n), np.arange(1, n)
        for _ in range(vocabulary.longest):
            state = vocabulary.step(state, heads[at])
            on = np.flatnonzero(state)
            if not len(on):
                break
            state, where, at = state[on], where[on], shorter[at[on]]
            ids = vocabulary.piece[state]
            some = np.flatnonzero(ids >= 0)
            found.append((where[some], ids[some], at[some]))
            on = np.flatnonzero(at)
            state, where, at = state[on], where[on], at[on]
        alone = np.ones(n, bool)
        alone[0] = False
        for nodes, *_ in found[:1]:
            alone[nodes] = False
        raw = np.flatnonzero(alone)
        counts = alone.astype(np.int64)
        for nodes, *_ in found:
            counts[nodes] += 1
        #: First and last edge of each node, long pieces first.
        self.first_a = np.r_[0, np.cumsum(counts)]
        self.last_a = self.first_a[1:] - 1
        fill, total = self.first_a[:-1].copy(), int(self.first_a[-1])
        self.ids_a, self.end_a, score = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total)
        width = 1 + (heads[raw] > 0x7F).astype(np.int64) + (heads[raw] > 0x7FF) + (heads[raw] > 0xFFFF)
        for nodes, ids, ends in [*found[::-1], (raw, None, shorter[raw])]:
            to = fill[nodes]
            self.ids_a[to] = ~heads[nodes] if ids is None else ids
            self.end_a[to] = ends
            score[to] = width * vocabulary.weight[-1] if ids is None else vocabulary.weight[ids]
            fill[nodes] = to + 1
        beta = np.zeros(n)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            c, edges = counts[lo:hi], slice(self.first_a[lo], self.first_a[hi])
            begin = self.first_a[lo:hi] - edges.start
            s = score[edges] + beta[self.end_a[edges]]
            top = np.maximum.reduceat(s, begin)
            beta[lo:hi] = top + np.log(np.add.reduceat(np.exp(s - np.repeat(top, c)), begin))
        self.logp_a = np.minimum(score + beta[self.end_a] - np.repeat(beta, counts), 0.0)
        self.prob_a = np.exp(self.logp_a)
        with np.errstate(divide="ignore"):
            self.rest_a = np.log(-np.expm1(self.logp_a))
        self.rest_a[self.first_a[:-1][counts == 1]] = -np.inf

    def owner(self, edge: int) -> int:
        """The node that an edge leaves."""
        return int(np.searchsorted(self.first_a, edge, "right")) - 1

    def pieces(self, paths: list[np.ndarray]) -> list[np.ndarray]:
        """Piece ids of the edges of each path; an edge of bytes gives one id per byte."""
        ids = self.ids_a[np.concatenate(paths)]
        single = np.flatnonzero((ids < 0) & (ids >= -128))
        ids[single] = self.bytes_a[~ids[single]]
        ends = np.cumsum([len(p) for p in paths])
        out = np.split(ids, ends[:-1])
        odd = np.flatnonzero(ids < 0)
        for i in np.unique(np.searchsorted(ends, odd, "right")):
            out[i] = np.concatenate([[n] if n >= 0 else [self.byte[b] for b in chr(~n).encode("utf-8", "surrogatepass")] for n in out[i].tolist()]).astype(np.int32)
        return out


def _uniform(key: np.ndarray, *parts) -> np.ndarray:
    """Numbers in (0, 1) from row keys and counters (splitmix64)."""
    x = key
    for p in parts:
        x = x ^ np.asarray(p, np.uint64)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
    x >>= np.uint64(12)
    out = x.astype(np.float64)
    out += 0.5
    out *= 1 / float(1 << 52)
    return out


def _one(key: int, *parts: int) -> float:
    """``_uniform`` of a single key."""
    for p in parts:
        key = (key ^ p) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        key = (key ^ key >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        key ^= key >> 27
    return ((key >> 12) + 0.5) * (1 / float(1 << 52))


def _draw(lat: Lattices, nodes: np.ndarray, keys: np.ndarray, place: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """A path from each node to its word's end: edges in order, and where each word's edges begin."""
    live, at, steps = np.flatnonzero(nodes), nodes[nodes > 0], []
    counts = np.zeros(len(nodes), np.int64)
    while len(live):
        u = _uniform(keys[live], place[live], len(steps) + 1, turn)
        edge = lat.first_a[at]
        left = np.arange(len(live))
        while len(left):
            u[left] -= lat.prob_a[edge[left]]
            left = left[(u[left] > 0) & (edge[left] < lat.last_a[at[left]])]
            edge[left] += 1
        steps.append((live, edge))
        counts[live] += 1
        at = lat.end_a[edge]
        more = at > 0
        live, at = live[more], at[more]
    begin = np.r_[0, np.cumsum(counts)]
    out = np.empty(begin[-1], np.int64)
    for s, (which, edge) in enumerate(steps):
        out[begin[which] + s] = edge
    return out, begin


#: Kinds of draws; kind and turn are one counter, so that draws never repeat whatever k is.
_ROOT, _GROUP, _PICK, _TAIL, _AGAIN = (n << 40 for n in range(1, 6))


def _gumbel(key: np.ndarray, *parts) -> np.ndarray:
    u = _uniform(key, *parts)
    for _ in range(2):
        np.log(u, out=u)
        np.negative(u, out=u)
    return u


def _below(limit: np.ndarray | float, value: np.ndarray) -> np.ndarray:
    """Gumbel values truncated to lie under ``limit``."""
    return -np.logaddexp(-limit, -value)


class _Path:
    """A drawn path; ``after``, ``before`` and ``group`` begin at edge ``since``, ``base`` is the log probability up to there."""

    __slots__ = ("edges", "begin", "since", "base", "value", "after", "before", "group", "out")

    def __init__(self, edges: np.ndarray, begin: np.ndarray, since: int, base: float, value: float) -> None:
        self.edges, self.begin, self.since, self.base, self.value, self.out = edges, begin, since, base, value, {}


def _emit(lat: Lattices, keys: np.ndarray, paths: list[_Path], turn: int) -> None:
    """The log probabilities along new paths, one of each key, and the best perturbed values of the branches that leave them."""
    sizes = np.array([len(p.edges) - p.since for p in paths])
    ends = np.cumsum(sizes)
    begin = ends - sizes
    flat = np.concatenate([p.edges[p.since :] for p in paths])
    logp = lat.logp_a[flat]
    after = logp.copy()
    some = sizes > 0
    after[begin[some]] += np.array([p.base for p in paths])[some]
    for lo, hi in zip(begin.tolist(), ends.tolist(), strict=True):
        np.add.accumulate(after[lo:hi], out=after[lo:hi])
    before = after - logp
    loc = before + lat.rest_a[flat]
    open_ = np.flatnonzero(np.isfinite(loc))
    owner = np.repeat(np.arange(len(paths)), sizes)[open_]
    place = open_ - (begin - np.array([p.since for p in paths]))[owner]
    group = np.full(len(flat), -np.inf)
    group[open_] = _below(np.array([p.value for p in paths])[owner], loc[open_] + _gumbel(keys[owner], _GROUP + turn, place))
    for p, lo, hi in zip(paths, begin.tolist(), ends.tolist(), strict=True):
        p.after, p.before, p.group = after[lo:hi], before[lo:hi], group[lo:hi]


def _branch(lat: Lattices, key: int, p: _Path, turn: int) -> tuple[int, int, list[int], float, float]:
    """The path's best branch is taken: (edge where it leaves, its word, the word's edges, log probability up to its first edge, that of the branches left there)."""
    j = int(p.group.argmax())
    t = j + p.since
    node = lat.owner(int(p.edges[t]))
    taken = p.out.setdefault(t, [int(p.edges[t])])
    choice = [e for e in range(int(lat.first_a[node]), int(lat.last_a[node]) + 1) if e not in taken]
    mass = np.cumsum(lat.prob_a[choice])
    pick = min(int(np.searchsorted(mass, _one(key, _PICK + turn, t) * mass[-1])), len(choice) - 1)
    taken.append(choice[pick])
    rest = float(sum(lat.prob_a[e] for e in choice if e not in taken))
    p.group[j] = -np.inf
    word = int(np.searchsorted(p.begin, t, "right")) - 1
    head = [*p.edges[p.begin[word] : t].tolist(), choice[pick]]
    at, step = int(lat.end_a[choice[pick]]), 0
    while at:
        u, e = _one(key, _TAIL + turn, t, step), int(lat.first_a[at])
        while (u := u - lat.prob_a[e]) > 0 and e < lat.last_a[at]:
            e += 1
        head.append(e)
        at, step = int(lat.end_a[e]), step + 1
    left = float(p.before[j] + math.log(rest)) if rest > 0 else -math.inf
    return t, word, head, float((p.after[j - 1] if j else p.base) + lat.logp_a[choice[pick]]), left


def _search(lat: Lattices, keys: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, k: int) -> list[tuple[list[_Path], float]]:
    """For each text of so many words, the first node of each of them given, its k best perturbed paths and the next value.

    Each turn takes the best branch of every text's paths; behind the branch's word the path is drawn afresh.
    """
    offset = np.r_[0, np.cumsum(sizes)]
    place, spread = np.arange(len(nodes)) - np.repeat(offset[:-1], sizes), np.repeat(keys, sizes)
    edges, begin = _draw(lat, nodes, spread, place, 0)
    new = [_Path(edges[begin[lo] : begin[hi]], begin[lo : hi + 1] - begin[lo], 0, 0.0, value) for lo, hi, value in zip(offset[:-1], offset[1:], _gumbel(keys, _ROOT, 0).tolist(), strict=True)]
    live, turn, paths, limit = list(range(len(sizes))), 0, [[] for _ in sizes], [0.0] * len(sizes)
    while live:
        _emit(lat, keys[live], new, turn)
        for i, p in zip(live, new, strict=True):
            paths[i].append(p)
        turn += 1
        todo = []
        for i in live:
            tops = [float(p.group.max()) if len(p.group) else -math.inf for p in paths[i]]
            limit[i] = max(tops)
            if turn < k and math.isfinite(limit[i]):
                p = paths[i][tops.index(limit[i])]
                todo.append((i, p, *_branch(lat, int(keys[i]), p, turn)))
        live = [i for i, *_ in todo]
        if not todo:
            break
        again = [(i, p, t, left) for i, p, t, *_, left in todo if left > -math.inf]
        if again:
            own, _, at, left = zip(*again, strict=True)
            values = _below(np.array([limit[i] for i in own]), np.array(left) + _gumbel(keys[list(own)], _AGAIN + turn, at))
            for (_, p, t, _), value in zip(again, values.tolist(), strict=True):
                p.group[t - p.since] = value
        later = np.concatenate([np.arange(offset[i] + word + 1, offset[i + 1]) for i, _, _, word, *_ in todo])
        edges, begin = _draw(lat, nodes[later], spread[later], place[later], turn)
        new, lo = [], 0
        for i, p, t, word, head, base, _ in todo:
            hi = lo + int(sizes[i]) - word - 1
            kept = int(p.begin[word])
            joined = np.concatenate([p.edges[:kept], np.array(head, np.int64), edges[begin[lo] : begin[hi]]])
            new.append(_Path(joined, np.concatenate([p.begin[: word + 1], begin[lo : hi + 1] - begin[lo] + kept + len(head)]), t + 1, base, limit[i]))
            lo = hi
    return list(zip(paths, limit, strict=True))


def _log_inclusion(logp: float, limit: float) -> float:
    """Log of the probability that the path's perturbed value passes the limit."""
    if not math.isfinite(limit):
        return 0.0
    gap = logp - limit
    return gap if gap < -30 else min(0.0, math.log(-math.expm1(-math.exp(min(gap, 50.0)))))


_VOCABULARIES: dict[tuple, Vocabulary] = {}


def vocabulary(model: str = MODEL, sharpness: float = SHARPNESS) -> Vocabulary:
    """This worker's copy of a model's pieces."""
    if (model, sharpness) not in _VOCABULARIES:
        _VOCABULARIES[model, sharpness] = Vocabulary(model, sharpness)
    return _VOCABULARIES[model, sharpness]


def _words(texts: list[str | None]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, encoded by a dictionary, and where each text's words end.

    A word is a line end, or a run of marks and what follows up to the next mark or line end. Spaces become marks, and a text
    that is not empty begins with one.
    """
    each = [(MARK + t.replace(" ", MARK)).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    joined = b"".join(each)
    data, ends = np.frombuffer(joined, np.uint8), np.cumsum([len(t) for t in each], dtype=np.int64)
    begins = np.zeros(len(data) + 1, bool)
    mark = MARK.encode()
    marks = np.flatnonzero(data[: max(0, len(data) - 2)] == mark[0])
    marks = marks[(data[marks + 1] == mark[1]) & (data[marks + 2] == mark[2])]
    begins[marks[np.diff(marks, prepend=-len(mark)) != len(mark)]] = True
    lines = np.flatnonzero(data == 10)
    begins[lines] = begins[lines + 1] = begins[ends] = begins[0] = True
    places = np.flatnonzero(begins)
    words = pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(joined)])
    return words.dictionary_encode(), np.searchsorted(places, ends)


def sample_texts(texts: list[str | None], keys: list, k: int = SAMPLES, seed: int = SEED, model: str = MODEL, sharpness: float = SHARPNESS) -> list[list[tuple]]:
    """For each text its k samples (piece ids, log probability, perturbed value, log inclusion)."""
    words, ends_a = _words(texts)
    out: list[list[tuple]] = [[(np.empty(0, np.int32), 0.0, 0.0, 0.0)] for _ in texts]
    sizes = np.diff(ends_a, prepend=0)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    data, edges = words.dictionary.buffers()[2].to_pybytes(), np.frombuffer(words.dictionary.buffers()[1], np.int64, len(words.dictionary) + 1)
    chars = np.frombuffer(data[: edges[-1]].decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    heads = (np.frombuffer(data, np.uint8, edges[-1]) & 0xC0) != 0x80  # bytes that begin a character
    lat = Lattices(vocabulary(model, sharpness), chars, np.add.reduceat(heads, edges[:-1], dtype=np.int64))
    nodes = lat.start[words.indices.to_numpy()]
    own = np.array([xxhash.xxh3_64_intdigest(f"{seed}:{key}") for key in keys], np.uint64)
    for group in np.split(some, np.flatnonzero(np.diff(ends_a[some] // TURN_WORDS)) + 1):
        lo, hi = ends_a[group[0]] - sizes[group[0]], ends_a[group[-1]]
        found = _search(lat, own[group], nodes[lo:hi], sizes[group], k)
        ids = iter(lat.pieces([p.edges for paths, _ in found for p in paths]))
        for i, (paths, limit) in zip(group.tolist(), found, strict=True):
            logps = [float(p.after[-1]) if len(p.after) else p.base for p in paths]
            out[i] = [(next(ids), logp, p.value, _log_inclusion(logp, limit)) for p, logp in zip(paths, logps, strict=True)]
    return out


def decoded(ids: pa.ListArray, model: str = MODEL) -> pa.Array:
    """The text of each list of pieces: pieces joined, marks as spaces, without the leading one; null for null lists.

    All pieces of the column are joined as one run of bytes. Lists that do not begin with a mark or do not
    give UTF-8 are decoded one by one, with replacement characters where bytes are none.
    """
    v = vocabulary(model)
    each = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    taken = v.plain.take(ids.flatten())
    place = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
    data = np.frombuffer(taken.buffers()[2] or b"", np.uint8, place[-1])
    edges = place[np.r_[0, np.cumsum(each)]]
    some = np.flatnonzero(np.diff(edges))
    plain = not len(some) or bool((data[edges[some]] == 32).all())
    if plain:
        data = np.delete(data, edges[some])
        edges -= np.r_[0, np.cumsum(np.diff(edges) > 0)]
        try:
            data.tobytes().decode()
            plain = edges[-1] < 1 << 31 and not ((data[np.minimum(edges[:-1], len(data) - 1)] & 0xC0) == 0x80).any() if len(data) else True
        except UnicodeDecodeError:
            plain = False
    valid = ids.is_valid()
    if plain:
        texts = pa.Array.from_buffers(pa.string(), len(ids), [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    else:
        texts = pa.array([b"".join([v.text[i] for i in x or ()]).decode("utf-8", "replace").replace(MARK, " ")[1:] for x in ids.to_pylist()], pa.string())
    return pc.if_else(valid, texts, pa.scalar(None, pa.string()))


def encode(docs: DataFrame, k: int = SAMPLES, seed: int = SEED, model: str = MODEL, sharpness: float = SHARPNESS, id_col: str = "doc_id", text_col: str = "text", decode_too: bool = False) -> DataFrame:
    """(doc_id, sample, ids, log_prob, perturbed, log_inclusion): up to k distinct segmentations of each whole text.

    Samples are numbered from 1 in falling order of the perturbed value. A text with fewer than k
    segmentations gives all of them, with an inclusion of 1. A null or empty text gives one empty
    segmentation. Draws depend on seed and id alone: rows that repeat an id and text give the same
    samples, and all rows with a null id share one key. A very long text is drawn word by word. Other columns are not read. An empty table
    gives an empty table. ``model`` is read where the tasks run. ``decode_too`` adds text, the
    sample's pieces decoded again, without a second pass over the ids.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = batch.column(0).to_pylist()
        each = sample_texts(batch.column(1).to_pylist(), keys, k, seed, model, sharpness)
        flat = [(key, n + 1, *s) for key, samples in zip(keys, each, strict=True) for n, s in enumerate(samples)]
        ids, ns, pieces, *numbers = zip(*flat, strict=True)
        offsets = np.r_[0, np.cumsum([len(p) for p in pieces])].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(pieces)))
        out = [pa.array(ids, pa.int64()), pa.array(ns, pa.int32()), lists, *(pa.array(x, pa.float64()) for x in numbers)]
        return pa.RecordBatch.from_arrays([*out, decoded(lists, model)] if decode_too else out, names=names)

    names = ["doc_id", "sample", "ids", "log_prob", "perturbed", "log_inclusion", *(["text"] if decode_too else [])]
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(picked, make, "doc_id long, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double" + (", text string" if decode_too else ""), rows=ROWS)


def decode(encoded: DataFrame, model: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with text: the pieces joined, marks as spaces, without the leading one; null for null ids.

    A column called text is replaced; all others stay, repeated rows too. An empty table gives an empty table.
    """
    names = [c for c in encoded.columns if c != "text"]

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, decoded(batch.column(names.index(ids_col)), model)], names=[*names, "text"])

    fields = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in names)
    return map_batches(encoded.select(*(F.col(f"`{c}`") for c in names)), make, f"{fields}, text string")
