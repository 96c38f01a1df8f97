"""Personal data: base rules, and identifiers found by bootstrapped contexts.

Base rules find emails, IP addresses, card numbers and phone numbers.  These, and keys
(hexadecimal strings of 32 or more digits with letters and figures), are the seeds.

Every token of an identifier's shape (six characters or more, a digit among them) is an
instance, and its surroundings are its lexical patterns: the one, two and three words
before it with all marks between them, as in ``call me at _`` or ``token = "_``, and the
first two of these together with the word after it.  Seeds induce patterns: those around
``SUPPORT`` distinct certain instances or more, in a table of any size.  How often each
is filled by a token that is no identifier is counted over all texts, by hashes of the
words around every token; a filter of fixed size keeps back those of no induced pattern.

Spark scores the pattern-instance graph in rounds: a pattern by the trust in its distinct
instances (those trusted at ``CONFIDENT`` or more) over their number and that count, an
instance by the best of its patterns (seeds stay certain).  As the patterns of one place
go together, they do not add up, so a pattern half of whose instances are known never
talks itself up.  Instances of patterns scored ``CONFIDENT`` or more are
believed, found wherever they occur as kind ``ident``, and are seeds of the next
bootstrap, until one believes nothing new or ``BOOTSTRAPS`` are done.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.staging import delete, noted, stage
from graphloom.llm.words import mix

KINDS = ("email", "ip", "card", "phone", "ident")
ROUNDS = 3
BOOTSTRAPS = 3
SUPPORT = 3
#: Share of what fills a pattern, identifiers or not, that has to be known: half, as an unknown identifier is no error.
CONFIDENT = 0.5
#: Where the instance stands in a pattern: lowered texts have no line ends.
SLOT = "\n"
#: 32-bit words of the filter of induced patterns: 32 bits each, half a megabyte in all, whatever the corpus.
FILTER_WORDS = 1 << 17
#: Texts are counted in chunks of whole texts of about this length together.
CHUNK_CHARS = 1 << 20
#: Counts that a task holds before it hands them over.
HELD_CODES = 1 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins, which keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_KEY = re.compile(r"(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,}")
_SHAPED = re.compile(r"(?=[^\s\"'()\[\]<>{}=]*[0-9])[^\s\"'()\[\]<>{}=]{6,}")
_LABEL = re.compile(r"[^\W\d_]\w*[:#]")
_WORD = re.compile("[0-9A-Za-z_\x80-\U0010ffff]+")
_AFTER = re.compile("[^0-9A-Za-z_\x80-\U0010ffff]*[0-9A-Za-z_\x80-\U0010ffff]+")
#: Marks that end a token but don't belong to it, the longest word of a pattern, and how far patterns look.
TRAILING, WORD_CHARS, REACH = ".,;:!?", 32, 120
_LOWER = {c: c + 32 for c in range(65, 91)}


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base rules, by start and then kind as listed; code points, end exclusive."""
    found = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _lowered(text: str) -> str:
    """A-Z in lower case, white space as single spaces."""
    return re.sub(r"\s+", " ", text.translate(_LOWER))


def patterns_around(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a token's place: left words, ``SLOT``, and the word after it or nothing."""
    left = _lowered(text[max(0, start - REACH) : start])
    lefts = []
    for m in reversed(list(_WORD.finditer(left))):
        if (m.start() == 0 and start > REACH) or m.end() - m.start() > WORD_CHARS or len(lefts) == 3:
            break
        lefts.append(left[m.start() :] + SLOT)
    after = _AFTER.match(_lowered(text[end : end + REACH]))
    if after and after.end() <= WORD_CHARS:
        lefts += [x + after.group() for x in lefts[:2]]
    return lefts


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A token's range without a label before it and marks after it."""
    label = _LABEL.match(text, start, end)
    if label:
        start = label.end()
    while end > start and text[end - 1] in TRAILING:
        end -= 1
    return start, end


def _is_shaped(what: str) -> bool:
    return len(what) >= 6 and bool(_DIGIT.search(what))


def instances(text: str, base: list[tuple[str, int, int]], keys: re.Pattern = _KEY) -> list[tuple[str, int, int, bool, bool]]:
    """(instance, start, end, is a seed, is a base span) of the base spans and of all other tokens of an identifier's shape."""
    out = [(text[a:b], a, b, True, True) for _, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    at = 0
    if _DIGIT.search(text):
        for m in _SHAPED.finditer(text):
            start, end = _trimmed(text, *m.span())
            what = text[start:end]
            if not _is_shaped(what):
                continue
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            if not any(a < end and start < b for a, b in taken[at : at + 4]):
                out.append((what, start, end, bool(keys.fullmatch(what)), False))
    return out


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_PLACE = T.StructType(
    [T.StructField("instance", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
     T.StructField("seed", T.BooleanType()), T.StructField("is_base", T.BooleanType()), T.StructField("patterns", T.ArrayType(T.StringType()))]
)
_A_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_A_PLACE = pa.list_(
    pa.struct([("instance", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("is_base", pa.bool_()), ("patterns", pa.list_(pa.string()))])
)


def _scanned(keys: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(keys)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                spans, places = [], []
                for text in part.column("scanned").to_pylist():
                    text = text or ""
                    base = base_spans(text)
                    spans.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in base])
                    found = instances(text, base, pattern)
                    places.append([dict(zip(_PLACE.names, (*p, patterns_around(text, p[1], p[2])), strict=True)) for p in found])
                kept = [i for i, n in enumerate(part.schema.names) if n != "scanned"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in kept), pa.array(spans, _A_SPAN), pa.array(places, _A_PLACE)],
                    [*(part.schema.names[i] for i in kept), "base", "places"],
                )

    return run


_BYTE = np.arange(256)
_WORD_BYTE = (_BYTE >= 128) | np.isin(_BYTE, [ord(c) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"])
_GAP_BYTE = np.isin(_BYTE, [ord(c) for c in " \n\"'()[]<>{}="])
_DIGIT_BYTE = (_BYTE >= 48) & (_BYTE <= 57)
_TRAIL_BYTE = np.isin(_BYTE, [ord(c) for c in TRAILING])
_BYTE_KEYS = np.random.default_rng(71).integers(1, 2**63, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15
_UNSTEP = pow(_STEP, -1, 1 << 64)
_SIDE = np.uint64(0xC2B2AE3D27D4EB4F)


@functools.lru_cache(maxsize=2)
def _powers(step: int, length: int) -> np.ndarray:
    """``step`` to the power of 0, 1, 2 and so on, modulo 2^64."""
    powers = np.full(length, step, dtype=np.uint64)
    powers[0] = 1
    return np.cumprod(powers, out=powers)


class _Ranges:
    """Hashes of any byte ranges of a text, from one running sum: equal bytes have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        # powers are kept between chunks, in lengths that double
        length = 1 << max(21, len(data).bit_length())
        self.inverse = _powers(_UNSTEP, length)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_KEYS[data] * _powers(_STEP, length)[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(((self.sums[end] - self.sums[start]) * self.inverse[start]) ^ (end - start).astype(np.uint64))


def _code(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a pattern from those of its two sides; no words on the right are 0."""
    return mix(left + right * _SIDE)


def pattern_codes(patterns: list[str]) -> np.ndarray:
    """The hash of each pattern, as :func:`unfilled_codes` gives it."""
    sides = [x.encode() for p in patterns for x in p.split(SLOT)]
    ends = np.cumsum([len(x) for x in sides], dtype=np.int64)
    starts = np.concatenate((np.zeros(1, dtype=np.int64), ends))[: len(ends)]
    hashed = _Ranges(np.frombuffer(b"".join(sides), dtype=np.uint8))(starts, ends)
    return _code(hashed[::2], np.where(ends[1::2] > starts[1::2], hashed[1::2], np.uint64(0)))


def unfilled_codes(lowered: list[str]) -> np.ndarray:
    """Hashes of all patterns around tokens that are no identifiers, one for each place, in lowered texts.

    A token is cut as instances are: without a label before it, which ends a place of
    its own, and without marks after it.  One that begins with a digit or a plus sign may
    be a part of an identifier that holds spaces, and is not counted.
    """
    data = np.frombuffer("\n".join(["", *lowered, ""]).encode("utf-8", "replace"), dtype=np.uint8)
    none = np.zeros(0, dtype=np.uint64)
    edge = lambda inside: np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    word, token = edge(_WORD_BYTE[data]), edge(~_GAP_BYTE[data])
    (words, word_ends), (starts, stops) = (word[::2], word[1::2]), (token[::2], token[1::2])
    if not len(words) or not len(starts):
        return none
    at = np.minimum(np.searchsorted(words, starts), len(words) - 1)
    ends = np.minimum(word_ends[at], len(data) - 1)
    labelled = (words[at] == starts) & ~_DIGIT_BYTE[data[starts]] & (data[starts] != ord("_")) & (ends < stops) & np.isin(data[ends], (ord(":"), ord("#")))
    inner = np.where(labelled, ends + 1, starts)  # where the token without its label begins
    solid = np.maximum.accumulate(np.where(_TRAIL_BYTE[data], -1, np.arange(len(data))))
    outer = np.maximum(solid[stops - 1] + 1, inner)
    count = lambda mask: np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(mask)))
    digits, chars = count(_DIGIT_BYTE[data]), count((data & 0xC0) != 0x80)
    shaped = (chars[outer] - chars[inner] >= 6) & (digits[outer] > digits[inner])
    place, end = np.concatenate((starts, inner[labelled])), np.concatenate((outer, outer[labelled]))
    own = np.concatenate((shaped, shaped[labelled]))
    first = data[place]
    keep = ~own & ~_DIGIT_BYTE[first] & (first != ord("+")) & (place < np.concatenate((stops, stops[labelled])))
    place, end = place[keep], end[keep]
    lines = np.flatnonzero(data == 10)  # the text of a place lies between two of these
    before = lines[np.searchsorted(lines, place) - 1]
    behind = lines[np.searchsorted(lines, place)]
    ranges = _Ranges(data)
    zero = np.zeros(len(place), dtype=np.uint64)
    next_word = np.searchsorted(words, end)
    right_end = word_ends[np.minimum(next_word, len(words) - 1)]
    has_right = (next_word < len(words)) & (right_end <= behind)
    right = np.where(has_right, ranges(end, np.where(has_right, right_end, end)), zero)
    last = np.searchsorted(words, place)
    out = []
    for k in (1, 2, 3):
        begin = words[np.maximum(last - k, 0)]
        real = (last >= k) & (begin > before)
        left = ranges(begin[real], place[real])
        out.append(_code(left, zero[real]))
        if k < 3:
            both = has_right[real]
            out.append(_code(left[both], right[real][both]))
    return np.concatenate(out)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``pattern, code`` from rows ``pattern``."""
    for batch in batches:
        codes = pattern_codes(batch.column("pattern").to_pylist()).view(np.int64) if batch.num_rows else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("pattern"), pa.array(codes)], ["pattern", "code"])


def _pattern_filter(codes: DataFrame) -> np.ndarray:
    """``FILTER_WORDS`` words in which every code has its bit set, others by chance only."""
    word = F.pmod(F.shiftright("code", 5), F.lit(FILTER_WORDS)).cast("int").alias("word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("code").bitwiseAND(F.lit(31)).cast("int")).alias("bit")
    out = np.zeros(FILTER_WORDS, dtype=np.uint32)
    rows = codes.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most FILTER_WORDS rows
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
    return out


def _unfilled(bits: np.ndarray):
    """Counts, for each code that passes the filter, of its places that no identifier fills, from rows ``text``."""

    def counted(lowered: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = unfilled_codes(lowered)
        word = ((codes.view(np.int64) >> 5) % FILTER_WORDS).astype(np.int64)
        return np.unique(codes[(bits[word] >> (codes & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1], return_counts=True)

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        n = np.zeros(len(codes), dtype=np.int64)
        np.add.at(n, at, np.concatenate([k for _, k in parts]))
        return codes, n

    def rows(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n.astype(np.int64))], ["code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task sums the counts of its chunks, and hands over what it has whenever that is ``HELD_CODES`` or more
        parts, held, lowered, size = [], 0, [], 0
        for batch in batches:
            for text in batch.column("text"):
                lowered.append(_lowered(text.as_py() or ""))
                size += len(lowered[-1])
                if size >= CHUNK_CHARS:
                    parts.append(counted(lowered))
                    held, lowered, size = held + len(parts[-1][0]), [], 0
                if held >= HELD_CODES:
                    parts = [summed(parts)]
                    held = len(parts[0][0])
                    if held >= HELD_CODES // 2:
                        yield rows(*parts[0])
                        parts, held = [], 0
        parts.append(counted(lowered))
        yield rows(*summed(parts))

    return run


def scored_patterns(edges: DataFrame, noise: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """``pattern, score`` from distinct rows ``pattern, instance, certain`` and ``pattern, n``, how often no identifier fills it.

    Scores are one row per induced pattern, so no join is forced to broadcast them; the
    instances' side is partly summed before each shuffle.
    """
    trust = edges.withColumn("trust", F.col("certain").cast("double"))
    for k in range(rounds):
        scores = trust.groupBy("pattern").agg(F.sum(F.when(F.col("trust") >= confident, F.col("trust")).otherwise(0.0)).alias("sum"), F.count("*").alias("all"), F.count_if(F.col("trust") >= confident).alias("sure"))
        scores = scores.join(noise, "pattern", "left")
        share = F.col("sum") / (F.col("all") + F.coalesce("n", F.lit(0)))
        scores = stage(scores.select("pattern", F.when(F.col("sure") >= support, share).otherwise(F.lit(0.0)).alias("score")), "pattern-scores")
        if k == rounds - 1:
            return scores
        believed = edges.join(scores, "pattern").groupBy("instance").agg(F.max("score").alias("belief"))
        trust = edges.join(believed, "instance").withColumn("trust", F.when(F.col("certain"), F.lit(1.0)).otherwise(F.col("belief")))


def believed_instances(places: DataFrame, texts: DataFrame, bootstraps: int = BOOTSTRAPS, support: int = SUPPORT) -> DataFrame:
    """``instance`` of all that stand in a confident pattern, from rows ``instance, seed, is_base, patterns`` and rows ``text``."""
    with noted() as paths:
        known = _bootstrapped(places, texts, bootstraps, support)
    for path in paths:
        if path != getattr(known, "_staged_at", None):
            delete(places.sparkSession, path)
    return known


def _bootstrapped(places: DataFrame, texts: DataFrame, bootstraps: int, support: int) -> DataFrame:
    links = places.select("instance", "seed", "is_base", F.explode("patterns").alias("pattern"))
    links = stage(links.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.max("is_base").alias("is_base")), "pattern-graph")
    known, noise, n_known = None, None, 0
    for _ in range(bootstraps):
        sure = links.withColumn("certain", F.col("seed"))
        if known is not None:
            sure = links.join(known.withColumn("was_found", F.lit(True)), "instance", "left")
            sure = sure.withColumn("certain", F.col("seed") | F.coalesce("was_found", F.lit(False))).drop("was_found")
        induced = sure.filter("certain").groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= support).select("pattern")
        induced = stage(induced.mapInArrow(_coded, "pattern string, code long"), "induced")
        edges = stage(sure.join(induced, "pattern", "left_semi").select("pattern", "instance", "certain", "is_base"), "edges")
        fresh = induced if noise is None else induced.join(noise, "pattern", "left_anti")  # the texts are read again for these alone
        bits = _pattern_filter(fresh)
        if bits.any():
            counts = texts.mapInArrow(_unfilled(bits), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
            more = fresh.join(counts, "code", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("n"))
            noise = stage(more if noise is None else noise.unionByName(more), "noise")
        if noise is None:
            break
        good = scored_patterns(edges, noise, support=support).filter(F.col("score") >= CONFIDENT)
        found = edges.filter(~F.col("is_base")).join(good.select("pattern"), "pattern", "left_semi").select("instance").distinct()
        known = stage(found if known is None else known.unionByName(found).distinct(), "believed")
        old, n_known = n_known, known.count()
        if n_known == old:
            break
    return known if known is not None else places.select("instance").limit(0)


def annotate(docs: DataFrame, keep: list[str] | None = None, seed_keys: str = _KEY.pattern) -> DataFrame:
    """``docs`` (its columns ``keep``, by default all) with ``base`` and ``spans``: arrays of ``kind, start, end``, the second with what contexts add.

    Every row is scanned whole, by its own text; null is empty.  Spans that contexts
    add never overlap a base span.  Repeated rows are annotated alike.  Input columns
    named ``base`` or ``spans`` are replaced.  An empty table gives an empty result.
    ``seed_keys`` tells which tokens are keys known beforehand.
    """
    columns = [c for c in (docs.columns if keep is None else keep) if c not in ("base", "spans")]
    # input columns travel in a struct, so none can clash with a name used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.monotonically_increasing_id().alias("row_id"), F.col("text").alias("scanned"))
    schema = T.StructType([f for f in rows.schema.fields if f.name != "scanned"] + [T.StructField("base", T.ArrayType(_SPAN)), T.StructField("places", T.ArrayType(_PLACE))])
    scanned = stage(rows.mapInArrow(_scanned(seed_keys), schema), "scanned")
    places = scanned.select("row_id", F.explode("places").alias("p")).select("row_id", "p.*")
    known = believed_instances(places, docs.select("text"))
    found = places.filter("not is_base").join(known, "instance", "left_semi")
    added = found.groupBy("row_id").agg(F.collect_list(F.struct(F.lit("ident").alias("kind"), "start", "end")).alias("added"))
    joined = scanned.drop("places").join(added, "row_id", "left")
    # base kinds come first at an equal start: ident is the last of the kinds
    order = {k: i for i, k in enumerate(KINDS)}
    rank = lambda s: F.coalesce(*[F.when(s["kind"] == k, F.lit(i)) for k, i in order.items()])
    sort_key = lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    both = F.array_sort(F.transform(F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>"))), sort_key))
    plain = F.transform(both, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select(*[F.col("row")[c].alias(c) for c in columns], "base", plain.alias("spans"))


def count_of(kind: str, spans: str) -> F.Column:
    """Spans of one kind, as a long."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined_spans(spans: str) -> F.Column:
    """``kind:start:end`` of each span, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def masked(text: str, spans: str) -> F.Column:
    """The text with every span replaced by its kind in square brackets; overlapping spans become one, named after the first."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        before = F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(fresh, F.concat(acc["out"], before, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text))))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(F.col(text))


def spans_digest(spans: list[tuple[str, int, int]]) -> str:
    """The digest that the numbered query gives for base spans."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
