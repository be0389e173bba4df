"""Removal of repeated strings by prefix-free parsing.

Rolling-hash triggers cut every text into phrases: a place is a trigger if the hash of the WORD bytes there is the
least among the next SPAN places, seen from any of them. Triggers depend on nearby bytes only, so equal strings are cut
alike, and every window of WINDOW bytes holds one. All windows with the same first trigger form a family: a window of it
is a suffix of the phrase before the trigger, followed by a bounded prefix of the parse from the trigger on.

Sorting suffixes is only a means here: a window is repeated if, in corpus order, a neighbour shares WINDOW bytes, and
equal strings are neighbours. So classes of equal suffixes take the place of their ranks, which needs no global sort:

1. parse: the CORE bytes from a trigger on, common to its family, get a class (a hash); families whose class stands
   alone hold no repeated window;
2. dictionary: of the rest, the bytes that the family's windows cover get a class; if it stands twice, all of its
   windows do;
3. where one parse class has several dictionary classes, each window (phrase suffix and parse prefix together) gets a
   class among those of equal core, and classes are counted, copies of a dictionary entry only once with their number.

Each step is a grouped count with map-side sums, or a join on it; what is repeated a great many times is counted, not
gathered. Joins on a core are of stored tables, so a very common core's rows are split over tasks, and the windows of a
core with very many entries are dealt out by their class as well. Classes are 64-bit hashes within 64-bit cores, 128 bits
in all.

The symbols of a text are its bytes, or the 64-bit hashes of its words: the same parsing finds passages of so many words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checked_broadcast, chunks, in_arrow, mapped, sifted, stored, text_or_empty, to_arrow

#: Bytes of a string that must not repeat, places that one trigger rules at most, and bytes of a rolling hash.
WINDOW, SPAN, WORD = 400, 128, 8
#: Words of a passage that is reported where it repeats, and places that one trigger rules at most.
PASSAGE, PASSAGE_SPAN = 50, 24
#: Windows of a family that are counted together, so that a very common core is spread over tasks.
SLICE = 16
#: Entries of a core up to which its windows of one slice go to one task; beyond, they are dealt out by class.
ENTRIES = 2_000
#: Bytes of symbols parsed at once.
PARSE_BYTES = 1 << 20
#: Low bits of a place's hash that hold the place itself.
PLACE_BITS = 31
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def word_symbols(raw: bytes) -> bytes:
    """The hashes of a text's words, eight bytes each."""
    words = raw.split()
    known = {w: xxhash.xxh3_64_digest(w) for w in set(words)}
    return b"".join([known[w] for w in words])


def parse(texts: list[bytes], window: int = WINDOW, span: int = SPAN, unit: int = 1) -> tuple[np.ndarray, ...]:
    """Families of all texts, whose symbols have `unit` bytes (1 or 8): text number, first window, number of windows,
    trigger (offsets in the text, in symbols). Texts shorter than `window` have none."""
    lengths = np.array([len(t) // unit for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(ends) else 0
    empty = np.empty(0, dtype=np.int64)
    ok = np.ones(n, dtype=bool)
    for end, length in zip(ends.tolist(), lengths.tolist(), strict=True):
        ok[end - min(length, window - 1) : end] = False
    at = np.flatnonzero(ok)
    if not len(at):
        return empty, empty, empty, empty
    m = n + span
    raw = b"".join(texts) + bytes(WORD * 2 + span * unit)
    if unit == 1:
        h = np.ndarray((m,), "<u8", raw, strides=(1,)).copy()
    else:
        symbols = np.frombuffer(raw, "<u8")
        h = symbols[:m] * np.uint64(0xD6E8FEB86659FD93)
        h += symbols[1 : m + 1]
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    low = np.uint64((1 << PLACE_BITS) - 1)
    h &= ~low
    h |= low - np.arange(m, dtype=np.uint64)  # of equal hashes the last place is least
    done = 1
    while done < span:
        step = min(done, span - done)
        np.minimum(h[:-step], h[step:], out=h[:-step])
        h = h[:-step]
        done += step
    trigger = (low - (h[at] & low)).astype(np.int64)
    del h, ok
    first = np.flatnonzero(np.r_[True, (trigger[1:] != trigger[:-1]) | (at[1:] != at[:-1] + 1)])
    count = np.diff(np.r_[first, len(at)])
    at, trigger = at[first], trigger[first]
    text = np.searchsorted(ends, at, side="right")
    base = (ends - lengths)[text]
    return text, at - base, count, trigger - base


def signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def _symbols(text: str, unit: int) -> bytes:
    raw = text.encode("utf-8", "replace")
    return raw if unit == 1 else word_symbols(raw)


def _parts(texts: list[bytes], window: int, unit: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text number, first symbol, symbols) of about PARSE_BYTES; a longer text comes in parts that overlap, so
    each of its windows is in one part. A family that is cut so is settled window by window."""
    step = PARSE_BYTES // unit
    group, size = [], 0
    for number, raw in enumerate(texts):
        for start in range(0, max(1, len(raw) // unit - window + 1), step):
            part = raw if len(raw) <= PARSE_BYTES else raw[start * unit : (start + step + window - 1) * unit]
            if group and size + len(part) > PARSE_BYTES:
                yield group
                group, size = [], 0
            group.append((number, start, part))
            size += len(part)
            if len(raw) <= PARSE_BYTES:
                break
    if group:
        yield group


def _families(window: int, span: int, unit: int):
    core = (window - span + 1) * unit

    def work(part: pa.RecordBatch) -> dict:
        cores, covers, columns, digest = [], [], [], xxhash.xxh3_64_intdigest
        t1, t2 = (part[c].to_numpy(zero_copy_only=False) for c in ("t1", "t2"))
        for group in _parts([_symbols(t, unit) for t in part["text"].to_pylist()], window, unit):
            text, lo, n, at = parse([x for _, _, x in group], window, span, unit)
            for t, a, k, q in zip(text.tolist(), (lo * unit).tolist(), n.tolist(), (at * unit).tolist(), strict=True):
                view = group[t][2]
                cores.append(digest(view[q : q + core]))
                covers.append(digest(view[a : a + (k - 1 + window) * unit], k))
            number, start = (np.array([x[i] for x in group], dtype=np.int64)[text] for i in (0, 1))
            columns.append((t1[number], t2[number], (lo + start).astype(np.int32), n.astype(np.int32), (at - lo).astype(np.int32)))
        joined = [np.concatenate(c) for c in zip(*columns, strict=True)]
        return dict(zip(("t1", "t2", "lo", "n", "d"), map(pa.array, joined), strict=True)) | {"core": pa.array(signed(cores)), "cover": pa.array(signed(covers))}

    return work


SLICES = "core long, slice int, deal int, times int, t1 long, t2 int, lo int, i int, classes array<long>"


def _slices(window: int, unit: int):
    """Classes of every window of the families that are still open, in slices of equal distance to the trigger; where
    `fan` is over 1, each in a row of its own that is dealt by its class."""

    def run(batches):
        seen: set[tuple[int, int]] = set()  # copies of a text give the same rows: one of them in a task is enough
        target = to_arrow(SLICES)
        digest = xxhash.xxh3_64_intdigest
        out: dict[str, list] = {f.name: [] for f in target}
        for part in chunks(batches, "text", PARSE_BYTES):
            for text, t1, t2, families in zip(part["text"].to_pylist(), part["t1"].to_pylist(), part["t2"].to_pylist(), part["families"].to_pylist(), strict=True):
                if (t1, t2) in seen:
                    continue
                seen.add((t1, t2))
                raw = _symbols(text, unit)
                for lo, n, d, core, times, fan in zip(*[iter(families)] * 6, strict=True):
                    classes = signed([digest(raw[(lo + i) * unit : (lo + i + window) * unit]) for i in range(n)])
                    groups: dict[tuple[int, int], list[int]] = {}
                    for i in range(n):
                        groups.setdefault(((d - i) // SLICE, i if fan > 1 else -1), []).append(i)
                    for (number, alone), own in groups.items():
                        deal = int(classes[alone]) % fan if alone >= 0 else 0
                        for key, value in zip(out, (core, number, deal, times, t1, t2, lo, own[0], classes[own[0] : own[-1] + 1]), strict=True):
                            out[key].append(value)
                if len(out["core"]) >= 20_000:
                    yield pa.RecordBatch.from_pydict(out, schema=target)
                    out = {f.name: [] for f in target}
        if out["core"]:
            yield pa.RecordBatch.from_pydict(out, schema=target)

    return run


def _merge(window: int):
    """Families' repeated windows as merged byte ranges."""

    def run(batches):
        target = to_arrow("t1 long, t2 int, spans array<int>")
        for part in batches:
            merged = []
            for found in part["found"].to_pylist():
                runs: list[tuple[int, int]] = []
                for lo, n, low, high in zip(*[iter(found)] * 4, strict=True):
                    if low == high == -1:
                        runs.append((lo, lo + n - 1 + window))
                        continue
                    mask = (low & (1 << 64) - 1) | (high & (1 << 64) - 1) << 64
                    while mask:  # a run of ones at a time
                        first = (mask & -mask).bit_length() - 1
                        ones = (~(mask >> first) & (mask >> first) + 1).bit_length() - 1
                        runs.append((lo + first, lo + first + ones - 1 + window))
                        mask &= ~((1 << first + ones) - 1)
                merged.append(merge(runs))
            yield pa.RecordBatch.from_arrays([part["t1"], part["t2"], pa.array(merged, type=pa.list_(pa.int32()))], schema=target)

    return run


def text_keys(text: str = "text") -> list[Column]:
    """Two columns that identify a text: 96 bits of hash."""
    return [F.xxhash64(text).alias("t1"), F.hash(F.lit(7), F.col(text)).alias("t2")]


def spans(docs: DataFrame, window: int = WINDOW, span: int = SPAN, unit: int = 1) -> DataFrame:
    """For each distinct text with a repeated string of `window` symbols (bytes, or words where `unit` is 8): t1, t2 (its
    key) and spans, the merged ranges of symbols as [start, end, start, end, ...]. docs: t1, t2 and text, never null; rows
    of equal text are copies of it."""
    if not 2 <= span <= min(128, window - WORD):
        raise ValueError(f"a span of 2 to 128 places, less than the window by {WORD}, is needed")
    long_enough = docs.select("t1", "t2", "text").where(F.octet_length("text") >= (window if unit == 1 else 2 * window - 1))
    parsed = stored(mapped(long_enough, _families(window, span, unit), "t1 long, t2 int, lo int, n int, d int, core long, cover long", PARSE_BYTES), "families")
    again = stored(parsed.groupBy("core").count().where("count > 1").select("core"), "cores")
    families = stored(sifted(parsed, again, "core").join(again, "core"), "repeated-cores", done=[parsed, again])
    entries = stored(families.groupBy("core", "cover").agg(F.count("*").alias("times"), F.min(F.struct("t1", "t2", "lo", "n", "d")).alias("own")), "dictionary")

    mixed = entries.groupBy("core").agg(F.count("*").alias("k"), F.min("times").alias("least")).where("k > 1 AND least = 1")
    mixed = stored(mixed.select("core", F.ceil(F.col("k") / ENTRIES).cast("int").alias("fan")), "mixed-cores")
    open_ = entries.join(mixed, "core").select("own.*", "core", F.least("times", F.lit(2)).alias("times"), "fan")
    listed = F.flatten(F.collect_list(F.array(*[F.col(c).cast("long") for c in ("lo", "n", "d", "core", "times", "fan")])))
    by_text = stored(open_.groupBy("t1", "t2").agg(listed.alias("families")), "open-families", done=[mixed])
    texts = long_enough.join(checked_broadcast(by_text), ["t1", "t2"])
    sliced = in_arrow(texts, _slices(window, unit), SLICES).repartition("core", "slice", "deal")
    one = sliced.select("core", "slice", "deal", "times", "t1", "t2", "lo", "i", F.posexplode("classes").alias("k", "class"))
    total = F.sum("times").over(Window.partitionBy("core", "slice", "deal", "class"))
    single = one.withColumn("total", total).where("times = 1 AND total > 1").withColumn("i", F.col("i") + F.col("k"))
    bit = lambda from_: F.coalesce(F.bit_or(F.when((F.col("i") >= from_) & (F.col("i") < from_ + 64), F.expr(f"shiftleft(1L, i - {from_})"))), F.lit(0).cast("long"))
    some = single.groupBy("t1", "t2", "lo").agg(F.lit(128).alias("n"), bit(0).alias("low"), bit(64).alias("high"))

    full = entries.where("times > 1").select("core", "cover")
    whole = families.join(full, ["core", "cover"]).groupBy("t1", "t2", "lo").agg(F.max("n").alias("n"), F.lit(-1).cast("long").alias("low"), F.lit(-1).cast("long").alias("high"))
    found = F.flatten(F.collect_list(F.array(F.col("lo").cast("long"), F.col("n").cast("long"), "low", "high")))
    found = whole.unionByName(some).groupBy("t1", "t2").agg(found.alias("found"))
    return stored(in_arrow(found, _merge(window), "t1 long, t2 int, spans array<int>"), "spans", done=[families, entries, by_text])


ADDED = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words")


def removed(docs: DataFrame, window: int = WINDOW, span: int = SPAN, passage: int = PASSAGE, cut_passages: bool = False) -> DataFrame:
    """docs with `text` (null: empty) less every byte covered by a string of `window` bytes that also starts elsewhere in
    the table, and n_bytes, n_removed, n_spans, kept_sha256 of the remaining bytes; n_passage_words counts the words in
    passages of `passage` words that also start elsewhere, many of which have fewer than `window` bytes. With
    `cut_passages` their bytes go as well.

    Strings and passages are judged on the input and never cross documents; repeated rows are documents of their own, so
    all of a long one's bytes go. What is left of a character that was cut is dropped from the text, while kept_sha256 is
    of the exact bytes. Columns of these names in docs are replaced. An empty table gives no rows.
    """
    docs = docs.drop("t1", "t2", "spans", "passages", *ADDED).withColumn("text", text_or_empty())
    keyed = docs.select("*", *text_keys())
    found = spans(keyed, window, span)
    words = spans(keyed, passage, min(PASSAGE_SPAN, passage - WORD), 8).withColumnRenamed("spans", "passages")
    both = stored(found.join(words, ["t1", "t2"], "full"), "all-spans", done=[found, words])
    joined = keyed.join(checked_broadcast(both), ["t1", "t2"], "left").drop("t1", "t2")
    names = [c for c in docs.columns if c != "text"]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names), "text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long"])

    def cut(batches):
        for part in chunks(batches, "text", PARSE_BYTES):
            texts, out = [], {k: [] for k in ADDED}
            for text, ranges, passages in zip(part["text"].to_pylist(), part["spans"].to_pylist(), part["passages"].to_pylist(), strict=True):
                raw = text.encode("utf-8", "replace")
                ranges, gone = ranges or [], 0
                if passages and cut_passages:
                    ranges = merge([*pairs(ranges), *pairs(byte_ranges(text, passages))])
                kept = raw
                if ranges:
                    edges = [0, *ranges, len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    gone = len(raw) - len(kept)
                texts.append(kept.decode("utf-8", "ignore") if gone else text)
                in_passages = sum(passages[1::2]) - sum(passages[::2]) if passages else 0
                for key, value in zip(out, (len(raw), gone, len(ranges) // 2, hashlib.sha256(kept).hexdigest(), in_passages), strict=True):
                    out[key].append(value)
            columns = {c: part[c] for c in names} | {"text": pa.array(texts, type=pa.string())}
            yield pa.RecordBatch.from_pydict(columns | {k: pa.array(v, type=pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()})

    return in_arrow(joined, cut, schema)


def byte_ranges(text: str, passages: list[int]) -> list[int]:
    """Ranges of words as ranges of the text's UTF-8 bytes, from the first word's start to the last one's end."""
    at = [(m.start(), m.end()) for m in WORDS.finditer(text)]
    out, place, size = [], 0, 0
    for first, last in zip(passages[::2], passages[1::2], strict=True):
        for edge in (at[first][0], at[last - 1][1]):
            size += len(text[place:edge].encode("utf-8", "replace"))
            place = edge
            out.append(size)
    return out


def pairs(ranges: list[int]) -> list[tuple[int, int]]:
    return list(zip(ranges[::2], ranges[1::2], strict=True))


def merge(runs: list[tuple[int, int]]) -> list[int]:
    """[start, end, start, end, ...] of ranges in any order; those that touch become one."""
    out: list[int] = []
    for start, end in sorted(runs):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out
