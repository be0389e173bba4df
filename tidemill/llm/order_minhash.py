"""Order MinHash fingerprints, with DataFrame functions only.

A text is a list of words (one of over 16 characters is the list of its overlapping runs of 8, so that an insertion
changes only the runs that hold it); its k-mers of K words are numbered by occurrence, so
that the second one of a kind differs from the first. CELLS random orders of all k-mers are used; in each, the text's
two least k-mers are taken, put back into text order, and hashed as a pair. The pairs' hashes make the fingerprint; the
likeness of two is the square root of the share of cells that agree, as a pair agrees only if both of its members do.

Hash space is cut into CELLS equal ranges. Order c has the k-mers of range c first, by hash, and then all others by a
hash of (hash, c) of their own. So a text with two k-mers in the range needs no others to be looked at, and a short text
has a pair in every cell as soon as it has two k-mers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, text_or_empty

#: Cells of a fingerprint (a power of two, 2 ** CELL_BITS).
CELL_BITS = 6
CELLS = 1 << CELL_BITS
K = 2
WORD = r"[^\x20\x09-\x0D]+"
#: Words of more characters than LONG are read as their overlapping runs of RUN characters.
LONG, RUN = 16, 8
#: Low bits of a packed k-mer hold its place in the text, from 1; places above the largest share it.
PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1
#: Ranges that rows are dealt out in at most, and rows that are sampled for each.
MOST_RANGES, SAMPLED = 1 << 15, 20
#: Bytes of text in a range, about.
RANGE_BYTES = 16 << 20
KEY = "struct<known:int,id:long,hash:long>"


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`: CELLS longs, all null for a text without words. Temporary columns are named after `out`.

    Packed k-mers sort by hash, then place. Those that repeat the one before get a hash of (hash, occurrence). The
    ranges' lower bounds are sorted in with them, and the two entries after a bound are its cell's least. For a range
    with fewer than two all k-mers are hashed anew: the range's own k-mer comes first, then the least of the others.
    """
    w, s, e, a = (f"_{out}_{x}" for x in "wsea")
    clear = f"{~PLACE}L"
    df = df.withColumn(w, F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)))
    runs = F.flatten(F.transform(w, lambda x: F.when(F.char_length(x) > LONG, F.regexp_extract_all(x, F.lit(f"(?s)(?=(.{{{RUN}}}))."), F.lit(1))).otherwise(F.array(x))))
    df = df.withColumn(w, F.when(F.exists(w, lambda x: F.char_length(x) > LONG), runs).otherwise(F.col(w)))
    packed = f"transform(sequence(0, size({w}) - {K}), i -> (xxhash64({', '.join(f'{w}[i + {j}]' for j in range(K))}) & {clear}) | least(i + 1, {PLACE}))"
    short = f"IF(size({w}) > 0, array((xxhash64(concat_ws(' ', {w})) & {clear}) | 1), array())"
    df = df.withColumn(s, F.expr(f"sort_array(IF(size({w}) >= {K}, {packed}, {short}))"))
    again = f"filter({s}, (x, i) -> i > 0 AND (x & {clear}) = ({s}[greatest(i - 1, 0)] & {clear}))"
    df = df.withColumn(e, F.expr(again))
    heads = f"filter(sequence(0, size({e}) - 1), i -> i = 0 OR ({e}[i] & {clear}) != ({e}[greatest(i - 1, 0)] & {clear}))"
    df = df.withColumn(a, F.expr(f"IF(size({e}) > 0, {heads}, CAST(array() AS array<int>))"))
    repeats = f"flatten(transform({a}, (h, r) -> transform(slice({e}, h + 1, coalesce(get({a}, r + 1), size({e})) - h), (x, j) -> (xxhash64(x & {clear}, j + 1) & {clear}) | (x & {PLACE}))))"
    firsts = f"filter({s}, (x, i) -> i = 0 OR (x & {clear}) != ({s}[greatest(i - 1, 0)] & {clear}))"
    bounds = ", ".join(f"{(i - CELLS // 2) << (64 - CELL_BITS)}L" if i else f"({-(1 << 63) + 1}L - 1L)" for i in range(CELLS))
    v, s2, at, o = f"{a}1", f"{a}2", f"{a}3", f"{a}5"
    df = df.withColumn(v, F.expr(f"concat(IF(size({e}) > 0, {firsts}, {s}), IF(size({e}) > 0, {repeats}, array()))"))
    df = df.withColumn(s2, F.expr(f"sort_array(concat({v}, array({bounds})))"))
    df = df.withColumn(at, F.expr(f"filter(sequence(0, size({s2}) - 1), i -> ({s2}[i] & {PLACE}) = 0)"))
    in_cell = lambda d: f"(coalesce(get({s2}, p + {d}), 0) & {PLACE}) != 0"
    two = f"{in_cell(1)} AND {in_cell(2)}"
    mixed = lambda x: f"((xxhash64({x} & {clear}, c) & {clear}) | ({x} & {PLACE}))"
    pair = lambda x, y: f"IF(({x} & {PLACE}) <= ({y} & {PLACE}), xxhash64({x} & {clear}, {y} & {clear}), xxhash64({y} & {clear}, {x} & {clear}))"
    alls, rest = f"{a}4", f"{a}6"
    df = df.withColumn(alls, F.expr(f"transform({at}, (p, c) -> IF({two}, CAST(array() AS array<bigint>), transform({v}, x -> {mixed('x')})))"))
    df = df.withColumn(o, F.expr(f"transform({at}, (p, c) -> IF({two}, {s2}[p + 1], IF({in_cell(1)}, {mixed(f'{s2}[p + 1]')}, array_min({alls}[c]))))"))
    df = df.withColumn(rest, F.expr(f"transform({at}, (p, c) -> IF({two}, {s2}[p + 2], array_min(array_remove({alls}[c], {o}[c]))))"))
    first, second = f"{o}[c]", f"{rest}[c]"
    df = df.withColumn(out, F.expr(f"transform({at}, (p, c) -> CASE WHEN {first} IS NULL THEN NULL WHEN {second} IS NULL THEN xxhash64({first} & {clear}) ELSE {pair(first, second)} END)"))
    return df.drop(w, s, e, a, v, s2, at, alls, o, rest)


def as_text(cells: str) -> Column:
    """A fingerprint as text: eight hexadecimal digits a cell, or eight dashes."""
    return F.array_join(F.transform(cells, lambda x: F.coalesce(F.substring(F.lpad(F.hex(x), 16, "0"), 1, 8), F.lit("-" * 8))), "")


def likeness(a: str, b: str) -> Column:
    """0 to 1; two texts without words are alike."""
    same = F.size(F.filter(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")), lambda z: z["a"] == z["b"]))
    used = F.size(F.filter(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")), lambda z: z["a"].isNotNull() | z["b"].isNotNull()))
    return F.when(used == 0, 1.0).otherwise(F.sqrt(same / used))


def _bounds(keyed: DataFrame, range_bytes: int) -> DataFrame:
    """One row: the sorted keys that cut the rows into ranges of about `range_bytes` of text, or of more where there
    would be over MOST_RANGES. They come from a sample of SAMPLED rows a range, by its bytes."""
    spark = keyed.sparkSession
    rows, total = keyed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    n = min(MOST_RANGES, -(-total // range_bytes))
    bounds = []
    if n > 1:
        sample = keyed.select("_key", F.octet_length("text").alias("size")).sample(min(1.0, SAMPLED * n / rows), 7).collect()
        sample.sort(key=lambda r: tuple(r["_key"]))
        share, held = sum(r["size"] for r in sample) / n, 0
        for r in sample:
            held += r["size"]
            if held >= share:
                bounds.append(tuple(r["_key"]))
                held = 0
    return spark.createDataFrame([(sorted(set(bounds)),)], f"_bounds array<{KEY}>")


def _range() -> Column:
    """How many bounds are less than the key, by bisection."""
    step = f"shiftleft(1, {MOST_RANGES.bit_length() - 1} - k)"
    return F.expr(f"aggregate(sequence(0, {MOST_RANGES.bit_length() - 1}), 0, (p, k) -> IF(p + {step} <= size(_bounds) AND _bounds[least(p + {step}, size(_bounds)) - 1] < _key, p + {step}, p))")


def with_next(docs: DataFrame, add: Callable[[DataFrame], DataFrame], take: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """docs (doc_id, text) with what `add` adds to each row, and next_<c> for each c of `take`: the value in the next row
    by descending doc_id (null last), then descending hash of the text; after the last row comes the first.

    Rows are dealt out by ranges of (doc_id, hash), so a doc_id that many rows share is cut as well. The first row of
    each range is also sent to the range before it, as the end marker there, so no window spans more than one range.
    """
    keyed = docs.withColumn("_key", F.struct(F.col("doc_id").isNotNull().cast("int").alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("hash")))
    placed = keyed.join(F.broadcast(_bounds(keyed, range_bytes))).withColumn("_range", _range()).drop("_bounds")  # one row
    tops = stored(placed.groupBy("_range").agg(F.max("_key").alias("_top")), "range-tops")  # MOST_RANGES rows at most
    after = F.coalesce(F.lead("_range").over(Window.orderBy("_range")), F.min("_range").over(Window.partitionBy()))
    goals = tops.select(F.col("_range").alias("_of"), "_top", after.alias("_goal"))
    ends = placed.join(F.broadcast(goals), (F.col("_range") == F.col("_of")) & (F.col("_key") == F.col("_top")))
    ends = ends.select(*docs.columns, "_key", F.col("_goal").alias("_range")).dropDuplicates(["_range"])  # those that repeat are alike
    both = add(placed).withColumn("_end", F.lit(0)).unionByName(add(ends).withColumn("_end", F.lit(1)))
    window = Window.partitionBy("_range").orderBy("_end", F.col("_key").desc())
    return both.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in take]).where("_end = 0").drop("_range", "_end", "_key")


def fingerprints(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of every whole text (null: empty) and of its edited text, whose last floor(n/2) code points are
    replaced by as many of the next document's first ones, with the likeness to the edited and to the next text.
    Repeated rows get a row each and are each other's next; an only row is its own next; an empty table gives no rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    own = with_next(docs, lambda df: fingerprint(df, "text", "cells"), ["text", "cells"], range_bytes)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = own.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), (n - half)), F.substring("next_text", F.lit(1), half)))
    both = fingerprint(edited.drop("text", "next_text"), "edited", "edited_cells")
    return both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("cells").alias("fingerprint"), as_text("edited_cells").alias("edited_fingerprint"), likeness("cells", "edited_cells").alias("near_edited"), likeness("cells", "next_cells").alias("near_next"))
