"""Secret scan: strings that look like secrets, and strings near sensitive words that nothing known can compress."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from . import arrays

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Kinds in the order in which equal starts are listed, and their patterns.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run of 24 or more is found where a run of any length would be.
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
ASSIGN_WORDS = ("passw", "secret", "token", "api")
# Words near which a string is sensitive.
SENSITIVE_WORDS = ("api", "auth", "bearer", "cookie", "credential", "hmac", "key", "login", "passphrase", "passwd", "password", "private", "pwd", "salt", "secret", "session", "signature", "token")
SENSITIVE = re.compile("|".join(SENSITIVE_WORDS), re.IGNORECASE | re.ASCII)
# Identifiers of program texts, beside those of the corpus.
CODE_WORDS = """
access account address admin api app application array auth authorization backup base64 bearer bool boolean bucket cache catch certificate char class client cloud config
configuration connect connection const content context cookie count create credential database date debug default delete deploy describe development device digest directory
docker document domain double download email enable encoding encrypt endpoint environment error event example exception export extends false field file filename filter final
float format function generate global group handle handler hash header host https identifier implements import include index init input insert instance integer interface
internal invoke issuer java json jwt key lambda language length library limit linux list local localhost logger login long main manager master message metadata method model
module name namespace network node null number object online option order output package parameter parse passphrase password path payload permission placeholder platform
port prefix private process production project property protected provider proxy public python query queue random read redirect refresh region register release remote
repository request resource response return role root salt sample schema scope script search secret security select sequence server service session settings sha256 signature
source staging static status storage store string struct subject switch system table target template test thread throw timeout timestamp token true type undefined update
upload user username utils value variable vendor version void webhook window worker write
""".split()

IDENTIFIER = np.zeros(256, bool)
IDENTIFIER[[95, *range(65, 91), *range(97, 123)]] = True
# Identifiers of the corpus: their lengths, the buckets in which they are counted first, and how many buckets are looked into.
SHORTEST, LONGEST = 4, 32
BUCKETS, HEAVY = 1 << 16, 4096
PIECE = 4 << 20

_TOKEN = "[A-Za-z0-9+/_=~-]"
FOUND = "doc_id long, found array<struct<kind string, start long, end long, novelty double>>"
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))
Span = tuple[int, int, int, float | None]


def _identifiers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts; start, end and hash of every identifier in them."""
    data, offsets = arrays.text_bytes(column)
    # A text ends a run as well: a byte that is no letter is put between texts.
    inside = IDENTIFIER[data]
    starts, ends = arrays.runs(inside)
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[inside[cuts] & inside[cuts - 1]]
    starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    fit = (ends - starts >= SHORTEST) & (ends - starts <= LONGEST)
    starts, ends = starts[fit], ends[fit]
    return data, starts, ends, arrays.word_hashes(data, starts, ends)


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


def frequent_identifiers(documents: DataFrame, size: int) -> list[str]:
    """The identifiers that all texts have most often, about ``size`` bytes of them, the most frequent last.

    All identifiers are counted in hashed buckets; those in the fullest buckets are then
    counted by name. Both counts are added up within tasks first; only the last step, at
    most ``size`` bytes of names, comes to the driver.
    """
    texts = documents.select(F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for piece in arrays.slices(batch, "text", PIECE):
                found += np.bincount(_buckets(_identifiers(piece.column(0))[3]), minlength=BUCKETS)
        full = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(found[full])], ["bucket", "n"])

    counted = texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    heavy = np.zeros(BUCKETS, bool)
    heavy[[r["bucket"] for r in counted.orderBy(F.desc("n"), "bucket").limit(HEAVY).collect()]] = True

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            for piece in arrays.slices(batch, "text", PIECE):
                data, starts, ends, hashes = _identifiers(piece.column(0))
                at = np.flatnonzero(heavy[_buckets(hashes)])
                _, first, n = np.unique(hashes[at], return_index=True, return_counts=True)
                for i, times in zip(at[first].tolist(), n.tolist(), strict=True):
                    name = data[starts[i]:ends[i]].tobytes().decode()
                    held[name] = held.get(name, 0) + times
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["name", "n"])

    ranked = texts.mapInArrow(names, "name string, n long").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "name")
    out, filled = [], 0
    for row in ranked.limit(size // (SHORTEST + 1)).collect():
        filled += len(row["name"]) + 1
        if filled > size:
            break
        out.append(row["name"])
    return out[::-1]


class Novelty:
    """Share of a string's bytes that neither its surroundings nor the dictionary have.

    A compressor primed with the dictionary, which keeps what it can't copy as it is:
    the marginal bytes of a string are those it adds to its compressed surroundings.
    """

    def __init__(self, dictionary: bytes) -> None:
        # The fast strategy with a target length leaves literals uncoded, so only copies save bytes.
        params = zstandard.ZstdCompressionParameters(
            window_log=18, hash_log=16, chain_log=6, search_log=1, min_match=4, target_length=1, strategy=zstandard.STRATEGY_FAST, write_content_size=False)
        known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(compression_params=params, dict_data=known)

    def marginal(self, around: str, text: str) -> int:
        held, added = around.encode(errors="replace"), text.encode(errors="replace")
        return len(self.compressor.compress(held + b" " + added)) - len(self.compressor.compress(held + b" "))

    def share(self, around: str, text: str) -> float:
        return self.marginal(around, text) / len(text)


def patterns(text: str, low: str) -> list[Span]:
    """Spans of the three patterns, kind by its number; leftmost and not overlapping for each kind. low: the text in lower case."""
    out: list[Span] = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end(), None) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: s[:2])


class Scanner:
    """Finds the spans of one text. ``reach``: how far behind a sensitive word a string begins; ``around``: characters on either side to compare with."""

    def __init__(self, dictionary: bytes, least: int, reach: int, around: int, share: float) -> None:
        self.novelty, self.least, self.reach, self.around, self.share = Novelty(dictionary), least, reach, around, share
        self.start = re.compile(f"(?<!{_TOKEN}){_TOKEN}{{{least}}}")
        self.rest = re.compile(f"{_TOKEN}*")

    def candidates(self, text: str) -> Iterator[tuple[int, int]]:
        """Whole strings of letters, digits and signs, with a letter and a digit, that begin near a sensitive word."""
        done = 0
        for word in SENSITIVE.finditer(text):
            at, stop = max(done, word.end()), word.end() + self.reach
            while at < stop and (found := self.start.search(text, at, stop + self.least)):
                if found.start() > stop:
                    break
                end = self.rest.match(text, found.start()).end()
                token = text[found.start():end]
                if any(c.isdigit() for c in token) and any(c.isalpha() for c in token):
                    yield found.start(), end
                at = done = end

    def scan(self, text: str) -> list[Span]:
        low = text.lower()
        spans = patterns(text, low)
        if not any(w in low for w in SENSITIVE_WORDS):
            return spans
        known = [(s, e) for s, _, e, _ in spans]
        for start, end in self.candidates(text):
            if any(s < end and start < e for s, e in known):
                continue
            beside = text[max(0, start - self.around):start] + text[end:end + self.around]
            share = self.novelty.share(beside, text[start:end])
            if share >= self.share:
                spans.append((start, 3, end, share))
        return sorted(spans, key=lambda s: s[:2])


def scan(documents: DataFrame, dictionary_bytes: int = 32 << 10, least: int = 12, reach: int = 64, around: int = 128, share: float = 0.8) -> DataFrame:
    """doc_id and the spans of secrets (``found``: kind, start, end in code points, novelty) of every document.

    Three patterns come first: assignments to words such as password, access keys, and
    long hexadecimal runs. Then every string of ``least`` or more letters, digits and
    signs (with a letter and a digit) that begins within ``reach`` characters behind a
    sensitive word is measured: by how many bytes does it lengthen its surroundings,
    compressed by zstandard with a dictionary of identifiers? What names and words make
    up is copied from the dictionary or the text beside it and costs little; what adds
    ``share`` of its own length or more is incompressible, and reported as ``novel``
    unless it overlaps a span of the patterns.

    The dictionary holds common identifiers of programs and those that the corpus has
    most often, counted over all its texts (``frequent_identifiers``), letters only, so
    a secret that occurs a thousand times is not in it.

    Defined cases: null text counts as empty; null ids stay null; repeated rows give
    repeated results; a text without secrets has an empty list; texts are scanned as a
    whole whatever their length; only doc_id and text are read; an empty table gives no
    rows.
    """
    words = [*frequent_identifiers(documents, dictionary_bytes), *CODE_WORDS]
    dictionary = " ".join(words).encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(dictionary, least, reach, around, share)
        for batch in batches:
            for piece in arrays.slices(batch, "text", PIECE):
                spans = [[{"kind": KINDS[k], "start": s, "end": e, "novelty": n} for s, k, e, n in scanner.scan(text or "")] for text in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(spans, SPANS)], ["doc_id", "found"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)
