"""Language-model scoring: a smoothed n-gram model read as a weighted backoff automaton."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from . import arrays, units

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes of a hash that travel beside the bits of its bucket: of single tokens, of longer n-grams.
WIDTHS = (6, 5)
# Tokens of a text that are read in one go; the result is the same for any number.
PIECE = 256
END = np.uint64(0x5851F42D4C957F2D)
TOTALS = "tokens long, types long, once long, twice long"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass(frozen=True)
class Totals:
    """Training tokens, distinct ones, and those seen once and twice."""

    tokens: int
    types: int
    once: int
    twice: int

    @property
    def discount(self) -> float:
        """Absolute discount of single tokens, estimated from the rare ones."""
        return min(0.9, max(0.1, self.once / max(1, self.once + 2 * self.twice)))


def held_out(ids: pa.ChunkedArray | pa.Array, folds: int, fold: int) -> np.ndarray:
    """Documents that the model doesn't learn from: by the checksum of the id as text; null as the empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % folds == fold for i in ids.to_pylist()], bool)


def tokens(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of each text and an end after each; tokens before each text."""
    data, offsets = arrays.text_bytes(column)
    data = arrays.LOWER[data]
    starts, ends, first = arrays.word_spans(data, offsets)
    words = arrays.word_hashes(data, starts, ends)
    return np.insert(words, first[1:], END), first + np.arange(len(first))


def grams(values: np.ndarray, first: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length up to order: last token of every n-gram within a text, and its hash."""
    sums, room = arrays.prefix_sums(values), arrays.room(first, len(values))
    out = []
    for n in range(1, order + 1):
        starts = np.flatnonzero(room >= n)
        out.append((starts + n - 1, arrays.windows_hash(sums, n)[starts]))
    return out


def _width(kind: int) -> int:
    return WIDTHS[min(kind, 1)]


def _tally(found: list[tuple[np.ndarray, np.ndarray]], learn: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: distinct n-grams of a unit in order, how often each is learned, and which of them each n-gram is."""
    for kind, (last, hashes) in enumerate(found):
        keys, where, counts = np.unique(hashes & units.cut(bits, _width(kind)), return_inverse=True, return_counts=True)
        yield keys, counts if learn.all() else np.bincount(where, learn[last], len(keys)).astype(np.int64), where


def score_documents(documents: DataFrame, order: int = 2, concentration: float = 200.0, folds: int = 7, fold: int = 2) -> DataFrame:
    """Log10 probability of every text under an n-gram model of the others.

    The model is a weighted backoff automaton. Its states are the contexts seen in
    training, from the empty one to ``order - 1`` tokens. A token seen after a context
    has an arc there, whose probability mixes its count with its probability after the
    next shorter context; for any other token a failure arc with the weight
    ``concentration / (count + concentration)`` leads to the shorter one. The
    weights of a context sum to one (hierarchical Dirichlet smoothing). Single tokens are
    discounted, and what is taken off is the probability of an unseen token. One walk
    from left to right carries the state of a text and adds up the weights of its arcs.

    The automaton is never held as a whole: units send their distinct n-grams with
    their counts, buckets add them up, and each unit gets back the counts of its own
    n-grams that other units share. A unit then builds the part that its texts can
    reach, and walks all of them token by token at once.

    Texts are lower-cased in A-Z and cut at white space; an end follows each, counted
    as a token. Learned are those whose ``crc32(doc_id as text) mod folds`` is not
    ``fold``. Defined cases: null and empty text are just the end; a null ``doc_id``
    counts as empty text and is learned; repeated rows count each time; without any
    learned token every probability is 1; only ``doc_id`` and ``text`` are read; an
    empty table gives no rows. Tokens are told apart by 48 bits beside those of their
    bucket, longer n-grams by 40. ``base_score`` is the add-one model of single tokens.
    """
    if order < 1:
        raise ValueError("the order is one at least")
    plan = units.layout(documents, least_units=192)
    bits = plan.bits

    def counts(longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for at, piece in units.by_unit(batches, plan):
                values, first = tokens(piece.column("text"))
                learn = np.repeat(~held_out(piece.column("doc_id"), folds, fold), np.diff(first))
                for kind, (keys, count, _) in enumerate(_tally(grams(values, first, longest), learn, bits)):
                    yield units.requests(at, keys, count.astype(np.uint32), bits, _width(kind), kind)
        return run

    def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        keys, row, own, first = units.met(table, _width(table.column("bucket")[0].as_py() >> bits), np.uint32)
        return keys, row, own, np.add.reduceat(own.astype(np.int64), first), np.diff(np.concatenate([first, [len(keys)]]))

    def sums(table: pa.Table) -> pa.Table:
        total = merged(table)[3]
        return pa.table({"tokens": [int(total.sum())], "types": [int((total > 0).sum())], "once": [int((total == 1).sum())], "twice": [int((total == 2).sum())]})

    def add(table: pa.Table) -> pa.Table:
        keys, row, own, total, sizes = merged(table)
        spread = np.repeat(total, sizes)
        # A unit knows its own counts; it is told of those to which others add.
        shared = np.flatnonzero(spread != own)
        return units.answers(table, keys[shared], row[shared], spread[shared], _width(table.column("bucket")[0].as_py() >> bits))

    held = units.rows(documents, plan)
    row = held.mapInArrow(counts(1), units.REQUEST).groupBy("bucket").applyInArrow(sums, TOTALS).agg(*(F.sum(c).alias(c) for c in Totals.__dataclass_fields__)).first()
    totals = Totals(*(x or 0 for x in row))

    def traverse(left: pa.Table, replies: pa.Table) -> pa.Table:
        texts = units.unpack(left)
        values, first = tokens(texts.column("text"))
        out = held_out(texts.column("doc_id"), folds, fold)
        known = replies.column("bucket").to_numpy() >> bits
        of_all = []
        found = grams(values, first, order)
        for kind, (keys, count, where) in enumerate(_tally(found, np.repeat(~out, np.diff(first)), bits)):
            shared, total = units.answered(replies.filter(pa.array(known == kind)), bits, _width(kind), np.int64)
            hit = units.among(keys, shared)
            count[hit] = total[np.searchsorted(shared, keys[hit])]
            of_all.append((found[kind][0] - kind, where, count))
        seen = of_all[0][2][of_all[0][1]]
        base = np.log10((seen + 1) / (totals.tokens + totals.types + 1))
        score = build(of_all, concentration, totals).traverse(of_all[0][1], first, order - 1) if totals.tokens else np.zeros(len(base))
        n = len(texts)
        add_up = (lambda x: np.add.reduceat(x, first[:-1])) if n else (lambda x: x[:0])
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": pa.array(out), "n_tokens": pa.array(np.diff(first).astype(np.int64)),
            "n_known": pa.array(add_up((seen > 0).astype(np.int64))), "train_tokens": pa.array(np.full(n, totals.tokens, np.int64)),
            "base_score": pa.array(add_up(base)), "score": pa.array(add_up(score)),
        })

    replies = units.reply(held.mapInArrow(counts(order), units.REQUEST), add)
    return units.with_replies(documents, plan, replies, traverse, RESULT)


@dataclass(frozen=True)
class Automaton:
    """Weighted backoff automaton over the tokens of a unit; all weights are log10.

    States are contexts seen in training: number 0 the empty one, then those of one
    token, of two, and so on. An arc reads a token that training has seen after the
    context, and leads to the longest context that is a state then. Where a state has no
    arc for a token, its failure arc leads to the context without its first token
    and reads nothing; the empty one has none and reads any unseen token instead.
    """

    types: int
    arcs: np.ndarray  # state * types + token, ascending
    target: np.ndarray
    weight: np.ndarray
    failure: np.ndarray  # by state
    penalty: np.ndarray  # by state; that of the empty context is the weight of an unseen token

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after each has read its token, and the weights of the arcs taken."""
        after, score, left = np.zeros(len(state), np.int64), np.zeros(len(state)), np.arange(len(state))
        while len(left):
            at, hit = _find(self.arcs, state * self.types + token[left])
            after[left[hit]], score[left[hit]] = self.target[at[hit]], score[left[hit]] + self.weight[at[hit]]
            left, state = left[~hit], state[~hit]
            score[left] += self.penalty[state]
            left, state = left[state > 0], self.failure[state[state > 0]]
        return after, score

    def traverse(self, words: np.ndarray, first: np.ndarray, lead: int, piece: int = PIECE) -> np.ndarray:
        """Weight of every token, all texts read from left to right at once.

        A state is no longer than ``lead`` tokens, so a long text may be read in pieces:
        each first reads the ``lead`` tokens before it, which lead to the state that
        a reader from the front would carry.
        """
        out, sizes = np.zeros(len(words)), np.diff(first)
        pieces = -(-sizes // piece)
        text = np.repeat(np.arange(len(sizes)), pieces)
        begin = first[text] + piece * (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        size = np.minimum(begin + piece, first[text + 1]) - begin
        # The longest come first, so those that go on are always the first ones.
        longest = np.argsort(-size, kind="stable")
        text, begin, size = text[longest], begin[longest], size[longest]
        state = np.zeros(len(begin), np.int64)
        for back in range(lead, 0, -1):
            inside = begin - back >= first[text]
            state[inside] = self.step(state[inside], words[begin[inside] - back])[0]
        for ahead in range(size[0] if len(size) else 0):
            going = np.searchsorted(-size, -ahead, "left")
            at = begin[:going] + ahead
            state, out[at] = self.step(state[:going], words[at])
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted value among ascending keys, and whether it is there."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def build(grams_of: list[tuple[np.ndarray, np.ndarray, np.ndarray]], concentration: float, totals: Totals) -> Automaton:
    """Automaton of the n-grams of a unit: for each length their starts, which of the distinct ones each is, and the training counts of those.

    An arc exists for each n-gram with a count. Its probability mixes the count with that
    of the arc for the same token from the next shorter context, which exists too.
    """
    order, types = len(grams_of), len(grams_of[0][2])
    size = len(grams_of[0][0])
    numbers, states = [], 1
    for _, _, count in grams_of[:-1]:
        numbers.append(np.where(count > 0, states - 1 + np.cumsum(count > 0), 0))
        states += int((count > 0).sum())
    failure, penalty = np.zeros(states, np.int64), np.zeros(states)
    penalty[0] = np.log10(totals.discount * totals.types / totals.tokens)
    word, below, of_shorter = grams_of[0][1], np.zeros(0), np.zeros(0, np.int64)
    arcs, targets, weights = [], [], []
    for n, (starts, where, count) in enumerate(grams_of, 1):
        of_start, place = np.zeros(size, np.int64), np.zeros(len(count), np.int64)
        of_start[starts], place[where] = where, starts
        seen = np.flatnonzero(count > 0)
        place, count_seen = place[seen], count[seen]
        chance = np.zeros(len(count))
        if n == 1:
            source = shorter = np.zeros(len(seen), np.int64)
            chance[seen] = (count_seen - totals.discount) / totals.tokens
        else:
            prefix, suffix = of_shorter[place], of_shorter[place + 1]
            source, shorter = numbers[n - 2][prefix], numbers[n - 2][suffix]
            chance[seen] = (count_seen + concentration * below[suffix]) / (grams_of[n - 2][2][prefix] + concentration)
        target = shorter
        if n < order:
            target = numbers[n - 1][seen]
            failure[target], penalty[target] = shorter, np.log10(concentration / (count_seen + concentration))
        arcs.append(source * types + word[place + n - 1])
        targets.append(target)
        weights.append(np.log10(chance[seen]))
        below, of_shorter = chance, of_start
    keys = np.concatenate(arcs)
    by_key = np.argsort(keys, kind="stable")
    return Automaton(types, keys[by_key], np.concatenate(targets)[by_key], np.concatenate(weights)[by_key], failure, penalty)
