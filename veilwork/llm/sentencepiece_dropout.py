"""SentencePiece encoding with seeded merge-dropout, and decoding.

The vocabulary's pieces and scores come from a SentencePiece BPE model file (a parameter). Spaces become U+2581 and one is put in front, as the
model does. No piece holds a space after another character, so a text is encoded stretch by stretch (spaces, then
non-spaces), each with its own agenda of candidate merges, best score first, then leftmost. A candidate that comes up is skipped when the
keyed hash of (seed, doc_id, place of the stretch in the text, turn, merged piece) falls under the dropout rate; skipped candidates are put back
when a neighbouring merge succeeds, as in BPE-dropout. Rate 0 gives the model's own encoding.

Every occurrence of a word draws anew. What is kept for reuse follows from no draw: the graph of states that a stretch can pass through (see Cuts);
reruns agree. Characters that no piece covers become byte pieces, and so does U+2581 itself, which marks spaces in the pieces. Decoding joins pieces and bytes
and takes the front space away: it returns every text exactly.

Null text gives null tokens, an empty text no tokens. Repeated rows are encoded alike. A null doc_id counts as its own key. Other columns stay
when asked for by encode_column().
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow_batches, give_back, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NONE = 1 << 62
MASK = (1 << 64) - 1
MOST_SHORT = 40  # characters of a part whose cuts are kept; a state has a bit for each place inside
_loaded: dict[str, Pieces] = {}


class Pieces:
    """Ids, scores and bytes of a model's pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(self.text) if model.is_byte(i)}
        self.special = {i for i in range(len(self.text)) if model.is_control(i) or model.is_unknown(i)}
        self.id = {p: i for i, p in enumerate(self.text) if not model.is_byte(i) and i not in self.special}
        self.rank = {p: int(-model.get_score(i)) for p, i in self.id.items() if len(p) > 1}
        value = {i: b for b, i in self.bytes.items()}
        self.said = np.array([b"" if i in self.special else bytes([value[i]]) if i in value else p.replace(SPACE, " ").encode() for i, p in enumerate(self.text)], object)
        self.lines_apart = not any("\n" in p for p in self.id)

        self.line_end = array("i", self.bytes_of("\n")).tobytes()
        self.single = np.full(0x110000, -2, np.int64)
        for p, i in self.id.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        pairs = {}
        for p, r in self.rank.items():
            for c in range(1, len(p)):
                a, b = self.id.get(p[:c]), self.id.get(p[c:])
                if a is not None and b is not None:
                    pairs[a * len(self.text) + b] = (r, self.id[p])
        # Pairs by multiplicative hash: each slot holds the first pair that falls in it, the others are searched for
        keys = np.array(sorted(pairs), np.int64)
        self.slot_keys = np.full(1 << 20, -1, np.int64)
        self.slot_pairs = np.zeros(1 << 20, np.int64)
        slot, one = np.unique(self._slot(keys), return_index=True)
        self.slot_keys[slot], self.slot_pairs[slot] = keys[one], one
        self.late = np.zeros(1 << 20, bool)
        self.late[np.delete(self._slot(keys), one)] = True
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_values, self.pair_ids = np.array([pairs[k] for k in sorted(pairs)], np.int64).reshape(-1, 2).T.copy()

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def pairs_at(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of each pair of ids among pair_keys, -1 where there is no such merge or an id is negative."""
        key = np.where((a >= 0) & (b >= 0), a * len(self.text) + b, -2)
        slot = self._slot(key)
        same = self.slot_keys[slot] == key
        at = np.where(same, self.slot_pairs[slot], -1)
        if (again := ~same & self.late[slot]).any():
            sought = key[again]
            near = np.minimum(np.searchsorted(self.pair_keys, sought), len(self.pair_keys) - 1)
            at[again] = np.where(self.pair_keys[near] == sought, near, -1)
        return at

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of ids, NONE where there is none or an id is negative."""
        at = self.pairs_at(a, b)
        return np.where(at >= 0, self.pair_values[at], NONE)

    def bytes_of(self, text: str) -> list[int]:
        return [self.bytes[b] for b in text.encode("utf-8", "surrogatepass")]


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def skips(base: int, turn: int, best: int, limit: int) -> bool:
    """Whether the candidate of rank `best` that comes up at a turn is skipped: the keyed hash of an occurrence (base), turn and piece."""
    x = base + turn * 0x9E3779B97F4A7C15 + best * 0xC2B2AE3D27D4EB4F & MASK
    x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & MASK
    x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & MASK
    return x >> 32 < limit


def skips_many(base: np.ndarray, turn: int | np.ndarray, best: np.ndarray, limit: int) -> np.ndarray:
    """The same for arrays."""
    x = base + np.atleast_1d(turn).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + best.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x >> np.uint64(32) < np.uint64(limit)


def merge_short(part: list[str], rank: dict[str, int], limit: int, base: int) -> list[str]:
    """Pieces of a short stretch: the agenda is the list of ranks of neighbouring pairs."""
    get = rank.get
    agenda = [get(x + y, NONE) for x, y in zip(part, part[1:])]
    skipped: list[tuple[int, int]] = []
    turn = 0
    while agenda:
        best = min(agenda)
        if best == NONE:
            break
        i = agenda.index(best)
        turn += 1
        if limit and skips(base, turn, best, limit):
            agenda[i] = NONE
            skipped.append((i, best))
            continue
        if skipped:  # a merge succeeded: what was skipped stands again
            for j, r in skipped:
                agenda[j] = r
            skipped = []
        part[i] += part.pop(i + 1)
        del agenda[i]
        if i < len(agenda):
            agenda[i] = get(part[i] + part[i + 1], NONE)
        if i:
            agenda[i - 1] = get(part[i - 1] + part[i], NONE)
    return part


def merge_long(part: list, rank: dict[str, int], limit: int, base: int) -> list[str]:
    """The same for stretches of any length, with a heap and linked neighbours: n log n."""
    n = len(part)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple[int, int, str]] = []
    skipped: list[tuple[int, int, str]] = []
    turn = 0

    def offer(left: int) -> None:
        if after[left] < n:
            merged = part[left] + part[after[left]]
            if merged in rank:
                heapq.heappush(agenda, (rank[merged], left, merged))

    for i in range(n - 1):
        offer(i)
    while agenda:
        best, left, merged = agenda[0]
        right = after[left] if part[left] is not None else n
        heapq.heappop(agenda)
        if right >= n or part[left] + part[right] != merged:
            continue  # one of the two has been merged away
        turn += 1
        if limit and skips(base, turn, best, limit):
            skipped.append((best, left, merged))
            continue
        for again in skipped:
            heapq.heappush(agenda, again)
        skipped.clear()
        part[left], part[right] = merged, None
        after[left] = after[right]
        if after[right] < n:
            before[after[right]] = left
        offer(left)
        if before[left] >= 0:
            offer(before[left])
    return [p for p in part if p is not None]


def cut(stretch: str, voc: Pieces, limit: int, base: int, short: int = 48) -> list[int]:
    """Ids of one stretch."""
    merge = merge_short if len(stretch) <= short else merge_long
    ids: list[int] = []
    for p in merge(list(stretch), voc.rank, limit, base):
        i = voc.id.get(p)
        if i is not None:
            ids.append(i)
        else:
            ids.extend(voc.bytes_of(p))
    return ids


def symbols(stretches: list[str], voc: Pieces) -> np.ndarray:
    """A row of ids of single characters for each stretch: -1 behind its end, -2 for characters that are no pieces."""
    width = max(1, *map(len, stretches))
    codes = "".join([x.ljust(width, "\0") for x in stretches]).encode("utf-32-le", "surrogatepass")
    flat = voc.single[np.frombuffer(codes, np.uint32)].reshape(-1, width)
    flat[np.arange(width) >= np.fromiter(map(len, stretches), np.int64, len(stretches))[:, None]] = -1
    return flat


def merge_rows(flat: np.ndarray, voc: Pieces, decide) -> np.ndarray:
    """Rows of ids merged to their end; every round takes the best candidate of each row, and decide(rows, turn, ranks) says which are skipped."""
    final, width = flat.copy(), flat.shape[1]
    rows, sym = np.arange(len(flat)), flat
    true = voc.pair_ranks(sym[:, :-1], sym[:, 1:])
    work = true.copy()
    place = np.arange(width)
    turn = 0
    while len(rows) and width > 1:
        best = work.min(1)
        ended = best == NONE
        if ended.any():
            final[rows[ended]] = sym[ended]
            rows, sym, true, work, best = (x[~ended] for x in (rows, sym, true, work, best))
            if not len(rows):
                break
        turn += 1
        at = work.argmin(1)
        skip = decide(rows, turn, best)
        s = np.nonzero(skip)[0]
        work[s, at[s]] = NONE
        m = np.nonzero(~skip)[0]
        if not len(m):
            continue
        i = at[m]
        source = np.minimum(place + (place > i[:, None]), width - 1)
        row = np.arange(len(m))
        old = sym[m]
        new = np.take_along_axis(old, source, 1)
        new[:, -1] = -1
        new[row, i] = voc.pair_ids[voc.pairs_at(old[row, i], old[row, i + 1])]
        ranks = np.take_along_axis(true[m], np.minimum(source[:, :-1], width - 2), 1)
        ranks[:, -1] = NONE
        right = np.where(i + 1 < width, new[row, np.minimum(i + 1, width - 1)], -1)
        inside = i < width - 1
        ranks[row[inside], i[inside]] = voc.pair_ranks(new[row, i], right)[inside]
        left = i > 0
        ranks[row[left], i[left] - 1] = voc.pair_ranks(new[row[left], i[left] - 1], new[row[left], i[left]])
        sym[m], true[m], work[m] = new, ranks, ranks
    return final


def cut_many(stretches: list[str], voc: Pieces, limit: int, base: np.ndarray) -> np.ndarray:
    """What cut() gives for stretches of like length, all of them at once, as rows with -1 for nothing; those with characters that are no pieces are left to cut()."""
    flat = symbols(stretches, voc)
    fine = ~(flat == -2).any(1)
    key = base[fine].astype(np.uint64)
    done = merge_rows(flat[fine], voc, lambda r, turn, best: skips_many(key[r], turn, best, limit))
    if fine.all():
        return done
    odd = {k: cut(stretches[k], voc, limit, int(base[k])) for k in np.nonzero(~fine)[0].tolist()}
    out = np.full((len(flat), max(flat.shape[1], *map(len, odd.values()))), -1, np.int64)
    out[fine, : flat.shape[1]] = done
    for k, ids in odd.items():
        out[k, : len(ids)] = ids
    return out


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.all, self.n = np.empty(1024, dtype), 0

    def extend(self, x) -> None:
        if self.n + len(x) > len(self.all):
            self.all = np.concatenate([self.all[: self.n], np.empty(max(len(x), self.n // 2 + 1024), self.all.dtype)])
        self.all[self.n : self.n + len(x)] = x
        self.n += len(x)


class Cuts:
    """Cuts of parts as graphs of states. A state is how a part is cut at the moment (a bit for each place between two characters where a piece begins);
    after a merge nothing that was skipped before it counts, so a state decides all that can follow but the draws.

    A node is a state of which the best `skipped` candidates are skipped. It keeps the ranks that come up from there as long as nothing more is skipped, the
    states they come up in, and the ids that this ends in. An occurrence draws turn by turn, goes at a skip to the child for it, and ends where no turn is skipped: with the cut that
    cut() gives for its base. Nothing that depends on an occurrence is kept. What stands once in a run of texts (a part, or a skip in it), long parts and parts with
    characters that are no pieces get no node: such an occurrence is cut apart, by the same draws.

    A part is a stretch, or a stretch without its first space, or, when it begins with a line end, what follows that
    character. No piece holds a line end beside another character, so no merge reaches over one."""

    def __init__(self, voc: Pieces, limit: int, keep: int):
        self.voc, self.limit, self.keep = voc, limit, keep
        self.clear()

    def clear(self) -> None:
        self.root: dict[str, int] = {}
        self.known: dict[int, int] = {}  # node of a word, state and number of skipped candidates
        self.stretch: list[str] = []
        self.ended: list[bool] = []  # begins with a line end
        self.word, self.turns, self.skipped, self.step, self.at, self.size = (Grown(t) for t in (np.int32, np.int32, np.int32, np.int64, np.int64, np.int64))
        self.best, self.child, self.ids, self.seen = (Grown(np.int32) for _ in range(4))
        self.state = Grown(np.uint64)

    @staticmethod
    def _names(word: np.ndarray, state: np.ndarray, skipped: np.ndarray) -> list[int]:
        return [w << 46 | s << 6 | j for w, s, j in zip(word.tolist(), state.tolist(), skipped.tolist())]

    def shrink(self) -> None:
        """Let the rarest nodes go, so that at most half of `keep` stay."""
        n, least = self.word.n, 2
        seen, word = self.seen.all[:n], self.word.all[:n]
        while (seen >= least).sum() > self.keep // 2:
            least *= 2
        stay = seen >= least
        to = np.where(stay, np.cumsum(stay) - 1, -2)
        words, name = np.unique(word[stay], return_inverse=True)
        number = dict(zip(words.tolist(), range(len(words))))
        old, root, known, stretch, ended = self.__dict__.copy(), self.root, self.known, self.stretch, self.ended
        self.clear()
        self.root = {x: int(to[k]) for x, k in root.items() if k >= 0 and stay[k]}
        self.known = {number[x >> 46] << 46 | x & (1 << 46) - 1: int(to[k]) for x, k in known.items() if stay[k]}
        self.stretch, self.ended = [stretch[k] for k in words], [ended[k] for k in words]
        for flat, start, size in ((("best", "child", "state"), "step", "turns"), (("ids",), "at", "size")):
            size = old[size].all[:n][stay]
            begin = np.cumsum(size) - size
            index = np.repeat(old[start].all[:n][stay] - begin, size) + np.arange(int(size.sum()))
            for f in flat:
                x = old[f].all[index]
                getattr(self, f).extend(np.where(x >= 0, to[x], x) if f == "child" else x)
            getattr(self, start).extend(begin)
        self.word.extend(name)
        self.seen.extend(seen[stay] // 2)
        for f in ("skipped", "turns", "size"):
            getattr(self, f).extend(old[f].all[:n][stay])

    def read(self, part: str) -> tuple[bool, str]:
        if part[:1] == "\n":
            return True, part[1:]
        return False, part if part[:1] == SPACE else SPACE + part

    def apart(self, parts: list[str], base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences that have no node, each by its own draws: all ids, and where each one's begin and how many they are."""
        begin, size, pool, n = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), [], 0
        ended, stretch = zip(*map(self.read, parts))
        ended, long = np.array(ended), np.fromiter(map(len, stretch), np.int64, len(parts))
        group = np.where(long > MOST_SHORT, -1 - np.arange(len(parts)), -(-long // 3))
        by = np.argsort(group, kind="stable")
        for every in np.split(by, np.nonzero(np.diff(group[by]))[0] + 1):
            for some in (every[k : k + 8_000] for k in range(0, len(every), 8_000)):
                if group[some[0]] < 0:
                    rows = np.array([cut(stretch[some[0]], self.voc, self.limit, int(base[some[0]]))], np.int64)
                else:
                    rows = cut_many([stretch[k] for k in some.tolist()], self.voc, self.limit, base[some])
                rows = np.hstack([np.where(ended[some][:, None], np.frombuffer(self.voc.line_end, np.int32), -1), rows])
                size[some] = (rows >= 0).sum(1)
                begin[some] = n + np.cumsum(size[some]) - size[some]
                pool.append(rows[rows >= 0].astype(np.int32))
                n += len(pool[-1])
        return np.concatenate(pool), begin, size

    def _pieces(self, stretch: str, state: int) -> tuple[list[int], list[int]]:
        """Ids and first places of a state's pieces."""
        places = [0]
        while state:
            low = state & -state
            places.append(low.bit_length())
            state ^= low
        return [self.voc.id[stretch[a:b]] for a, b in zip(places, [*places[1:], len(stretch)])], places

    def _grow(self, words: np.ndarray, states: np.ndarray, skipped: np.ndarray) -> np.ndarray:
        """New nodes; -1 for characters that are no pieces."""
        out = np.full(len(words), -1, np.int64)
        pieces = np.fromiter((len(self.stretch[w]) for w in words), np.int64, len(words))
        whole = skipped == 0
        pieces[~whole] = np.bitwise_count(states[~whole]) + 1
        group = np.where(pieces > 0, -(-pieces // 3) * 2, 0) + whole
        for g in np.unique(group):
            every = np.nonzero(group == g)[0]
            for some in (every[k : k + 4_000] for k in range(0, len(every), 4_000)):
                self._grow_some(some, words[some], states[some], skipped[some], int(pieces[some].max()), out)
        return out

    def _grow_some(self, some, words, states, skipped, width: int, out: np.ndarray) -> None:
        voc = self.voc
        if not width:
            sym = places = np.full((len(some), 1), -1)
        elif not skipped[0]:
            sym = symbols([self.stretch[k] for k in words], voc)
            fine = ~(sym == -2).any(1)
            some, words, states, skipped, sym = some[fine], words[fine], states[fine], skipped[fine], sym[fine]
            places = np.broadcast_to(np.arange(width), sym.shape)
        else:
            sym, places = np.full((len(some), width), -1), np.zeros((len(some), width), np.int64)
            for k, (w, s) in enumerate(zip(words.tolist(), states.tolist())):
                ids, at = self._pieces(self.stretch[w], s)
                sym[k, : len(ids)], places[k, : len(ids)] = ids, at
        final, rows, now = sym.copy(), np.arange(len(some)), states.copy()
        true = voc.pair_ranks(sym[:, :-1], sym[:, 1:])
        work = true.copy()
        for j in range(int(skipped.max(initial=0)) if width > 1 else 0):
            k = np.nonzero(skipped > j)[0]
            work[k, work[k].argmin(1)] = NONE
        turns, log, log_state = np.zeros(len(some), np.int32), np.zeros((len(some), width), np.int32), np.zeros((len(some), width), np.uint64)
        place = np.arange(width)
        turn = 0
        while len(rows) and width > 1:
            i = work.argmin(1)
            best = work[np.arange(len(rows)), i]
            ended = best == NONE
            if ended.any():
                final[rows[ended]] = sym[ended]
                rows, sym, true, places, now, best, i = (x[~ended] for x in (rows, sym, true, places, now, best, i))
                if not len(rows):
                    break
            log[rows, turn], log_state[rows, turn] = best, now
            turn += 1
            turns[rows] = turn
            row = np.arange(len(rows))
            merged = voc.pair_ids[voc.pairs_at(sym[row, i], sym[row, i + 1])]
            now = now & ~(np.uint64(1) << (places[row, i + 1] - 1).astype(np.uint64))
            source = np.minimum(place + (place > i[:, None]), width - 1)
            sym, places = np.take_along_axis(sym, source, 1), np.take_along_axis(places, source, 1)
            sym[:, -1] = -1
            sym[row, i] = merged
            true = np.take_along_axis(true, np.minimum(source[:, :-1], width - 2), 1)
            true[:, -1] = NONE
            inside = np.nonzero(i < width - 1)[0]
            true[inside, i[inside]] = voc.pair_ranks(merged[inside], sym[inside, i[inside] + 1])
            left = np.nonzero(i)[0]
            true[left, i[left] - 1] = voc.pair_ranks(sym[left, i[left] - 1], merged[left])
            work = true
        ended = np.fromiter((self.ended[k] for k in words), bool, len(some))
        final = np.hstack([np.where(ended[:, None], np.frombuffer(voc.line_end, np.int32), -1), final])
        node = self.word.n + np.arange(len(some))
        out[some] = node
        if self.limit:
            self.known.update(zip(self._names(words, states, skipped), node.tolist()))
        for f, x in (("word", words), ("skipped", skipped), ("seen", np.zeros(len(some), np.int32)), ("turns", turns), ("step", self.best.n + np.cumsum(turns) - turns)):
            getattr(self, f).extend(x)
        size = (final >= 0).sum(1)
        self.size.extend(size)
        self.at.extend(self.ids.n + np.cumsum(size) - size)
        self.ids.extend(final[final >= 0])
        on = np.arange(width) < turns[:, None]
        self.best.extend(log[on])
        self.state.extend(log_state[on])
        self.child.extend(np.full(int(turns.sum()), -2, np.int32))

    def _count(self, nodes: np.ndarray) -> None:
        self.seen.all[: self.seen.n] += np.bincount(nodes, minlength=self.seen.n).astype(np.int32)

    def _roots(self, parts: list[str]) -> np.ndarray:
        node = np.fromiter(map(self.root.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.nonzero(node == -1)[0].tolist()
        fresh = [x for x, n in Counter(parts[k] for k in new).items() if n > 1 and x not in self.root]
        if fresh:
            short = [x for x in fresh if len(x) <= MOST_SHORT]
            first = len(self.stretch)
            for ended, stretch in map(self.read, short):
                self.ended.append(ended)
                self.stretch.append(stretch)
            self.root.update(dict.fromkeys(fresh, -1))
            words = np.arange(first, first + len(short))
            states = np.array([(1 << max(0, len(self.stretch[w]) - 1)) - 1 for w in words.tolist()], np.uint64)
            self.root.update(zip(short, self._grow(words, states, np.zeros(len(short), np.int64)).tolist()))
            node[new] = [self.root.get(parts[k], -1) for k in new]
        return node

    def _children(self, parent: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Nodes for a skip at slots of parents; known states are found again."""
        first = slot == self.step.all[parent]
        word, state, skipped = self.word.all[parent], self.state.all[slot], np.where(first, self.skipped.all[parent] + 1, 1)
        names = self._names(word, state, skipped)
        found = [self.known.get(x, -1) for x in names]
        new = {x: k for k, x in enumerate(names) if found[k] < 0}
        if new:
            k = np.fromiter(new.values(), np.int64, len(new))
            self._grow(word[k], state[k], skipped[k])
            found = [self.known[x] for x in names]
        return np.array(found, np.int64)

    def find(self, parts: list[str], base: np.ndarray) -> np.ndarray:
        """Node of each occurrence; -1 for those that are better cut apart: parts and skips that stand once among these, long and odd ones."""
        if self.word.n > self.keep:
            self.shrink()
        node = self._roots(parts)
        self._count(node[node >= 0])
        live = np.nonzero(node >= 0)[0] if self.limit else np.empty(0, np.int64)
        turn = np.ones(len(live), np.int64)
        while len(live):
            hits = []
            slot, end = self.step.all[node[live]], None
            end = slot + self.turns.all[node[live]]
            key = base[live]
            while True:
                on = slot < end
                live, turn, slot, end, key = live[on], turn[on], slot[on], end[on], key[on]
                if not len(live):
                    break
                skip = skips_many(key, turn, self.best.all[slot], self.limit)
                hits.append((live[skip], turn[skip], slot[skip]))
                on = ~skip
                live, turn, slot, end, key = live[on], turn[on] + 1, slot[on] + 1, end[on], key[on]
            live, turn, slot = (np.concatenate(x) for x in zip(*hits)) if hits else (live, turn, slot)
            to = self.child.all[slot]
            missing = to == -2
            if missing.any():
                where, one, times = np.unique(slot[missing], return_index=True, return_counts=True)
                one, where = one[times > 1], where[times > 1]
                self.child.all[where] = self._children(node[live[missing][one]], where)
                to = self.child.all[slot]
            node[live] = np.maximum(to, -1)
            live, turn = live[to >= 0], turn[to >= 0] + 1
            self._count(node[live])
        return node


class Encoder:
    def __init__(self, path: str = MODEL, drop: float = 0.1, seed: int = 1, keep: int = 500_000):
        self.voc, self.seed = pieces(path), seed
        self.cuts = Cuts(self.voc, int(drop * 2.0**32), keep)

    def parts(self, text: str) -> list[str]:
        if self.voc.lines_apart:
            found = text.replace("\n", " \n").split(" ")
            if "" not in found:
                return found
        return STRETCH.findall(SPACE + text.replace(" ", SPACE))

    def bases(self, doc_id, n: int) -> np.ndarray:
        """Keys of the draws of a text's n parts."""
        start = xxhash.xxh3_64_intdigest(f"{self.seed}|{doc_id}".encode())
        x = np.uint64(start) + np.arange(n, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
        x = (x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(32)

    def encode(self, text: str, doc_id) -> np.ndarray:
        return self.encode_batch([text], [doc_id])[0]

    def encode_batch(self, texts, doc_ids, chunk: int = 4_000_000) -> list[np.ndarray | None]:
        """Ids of each text, None for None; texts are taken in runs of about `chunk` characters."""
        out: list[np.ndarray | None] = []
        run: list[tuple[str | None, object]] = []
        size = 0
        for text, doc_id in zip(texts, doc_ids):
            run.append((text, doc_id))
            size += len(text or "")
            if size >= chunk:
                out += self._encode_run(run)
                run, size = [], 0
        return out + self._encode_run(run)

    def _encode_marked(self, text: str, doc_id) -> np.ndarray:
        """Ids of a text that holds U+2581 itself: that character goes by its bytes, no merge reaches over it."""
        places = [STRETCH.findall((SPACE if not k else "") + x.replace(" ", SPACE)) for k, x in enumerate(text.split(SPACE))]
        base = iter(self.bases(doc_id, sum(map(len, places))).tolist())
        ids: list[int] = []
        for k, stretches in enumerate(places):
            ids += self.voc.bytes_of(SPACE) if k else []
            for x in stretches:
                ids += cut(x, self.voc, self.cuts.limit, next(base))
        return np.array(ids, np.int32)

    def _encode_run(self, run) -> list[np.ndarray | None]:
        every: list[str] = []
        bases, edge = [np.empty(0, np.uint64)], [0]
        for text, doc_id in run:
            if text and SPACE not in text:
                found = self.parts(text)
                every += found
                bases.append(self.bases(doc_id, len(found)))
            edge.append(len(every))
        base, cuts = np.concatenate(bases), self.cuts
        node = cuts.find(every, base)
        lone = np.nonzero(node < 0)[0]
        size, from_ = cuts.size.all[np.maximum(node, 0)], cuts.at.all[np.maximum(node, 0)]
        kept = cuts.ids.all[: cuts.ids.n]
        if len(lone):
            pool, from_[lone], size[lone] = cuts.apart([every[k] for k in lone.tolist()], base[lone])
            from_[lone] += len(kept)
            kept = np.concatenate([kept, pool])
        start = np.concatenate([[0], np.cumsum(size)])
        index = np.repeat(from_ - start[:-1], size)
        index += np.arange(start[-1])
        tokens = kept[index]
        ends = start[edge].tolist()
        return [None if text is None else self._encode_marked(text, i) if SPACE in text else tokens[a:b] for (text, i), a, b in zip(run, ends, ends[1:])]


def decode_ids(ids, voc: Pieces) -> str:
    """The text of a list of ids, byte pieces included; control pieces give nothing."""
    return b"".join(voc.said[np.asarray(ids, np.int64)].tolist()).decode("utf-8", "replace")[1:]


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "tokens", model: str = MODEL,
                  drop: float = 0.1, seed: int = 1) -> DataFrame:
    """docs with an array<int> column of ids; it replaces a column of that name.

    For jobs whose executors hold more than this step: Arrow batches of 8 MB, small runs, and fewer kept cuts than op1 takes."""
    bound_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        encoder = Encoder(model, drop, seed, keep=200_000)
        for ids, texts in batches:
            yield pd.Series(encoder.encode_batch([t if isinstance(t, str) else None for t in texts], [None if pd.isna(i) else int(i) for i in ids], chunk=1_000_000))
        del encoder
        give_back()

    encode = F.pandas_udf(run, "array<int>", F.PandasUDFType.SCALAR_ITER)
    return docs.withColumn(out_col, encode(F.col(id_col).cast("long"), F.col(text_col).cast("string")))


def decode_column(tokens: DataFrame, token_col: str = "tokens", out_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """tokens with the decoded text; null tokens give null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        voc = pieces(model)
        for batch in batches:
            yield pd.Series([None if t is None else decode_ids(t, voc) for t in batch])

    return tokens.withColumn(out_col, F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(F.col(token_col)))


def op1_sentencepiece(spark, sf_dir):
    """Ids of every whole text, their number, and whether decoding them returned the text."""
    bound_arrow_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder()
        for b in batches:
            rows = encoder.encode_batch(b["text"], [None if pd.isna(i) else int(i) for i in b["doc_id"]], chunk=2_000_000)
            back = [None if t is None else decode_ids(r, encoder.voc) == t for r, t in zip(rows, b["text"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": rows, "n_tokens": [None if r is None else len(r) for r in rows], "lossless": back})
        del encoder
        give_back()

    return docs.mapInPandas(run, "doc_id long, tokens array<int>, n_tokens long, lossless boolean")
