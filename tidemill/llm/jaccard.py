"""Exact join of texts by the Jaccard similarity of their word n-grams, with a token-group matrix.

Texts with equal shingle sets form one class. A class has its shingles in a global order (those found very often last,
else by hash); its prefix is the first n - ceil(t n) + 1 of them. The first shingle that two classes share, at places i
and j from 0, leaves min(n - i, m - j) at most to share, so it must stand in both prefixes, and in the smaller class
among those with m - j >= 2 t m / (1 + t): its early ones.

Classes are first put into groups of similar ones: in each prefix shingle's list two leaders are chosen, one of them the
member that has the shingle earliest (it differs least from what is common), members are compared with them, and what
is linked becomes a group. The matrix has a row for each group and early shingle of a member, so it holds the union of
the members' tokens with the bounds of their sizes and places. A class asks the matrix with its prefix; a group of
others is opened only where those bounds allow an overlap that is large enough, and of its members only those that
their own place and size allow are compared. So `linked` finds every link between groups, whatever groups were formed,
and its components are exact; a pair already connected is not compared, and so a group of copies costs a comparison a
member. `pairs` opens a class's own group too and returns every link, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BATCH_BYTES, checked_broadcast, chunks, in_arrow, stored, text_or_empty, to_arrow
from .components import components

#: Words of a shingle and least similarity in hundredths.
SIZE, PERCENT = 5, 80
#: A shingle counted so often (texts beside another one with it, within COUNTED shingles) is ordered last; at most so many
#: such shingles, the most frequent, are sent to the workers. Any set of them gives the same links: it only keeps common
#: passages out of the prefixes.
OFTEN, MOST_OFTEN = 4, 1_000_000
#: Shingles that are counted together before what stands once is left out.
COUNTED = 4_000_000
#: Bytes of text that are cut into shingles at once.
SHINGLE_BYTES = 2 << 20
#: Members that are compared with a leader in one task, and such tasks that are named in one row of the leader's.
MEMBERS, GOALS = 512, 1024


def shingles(texts: list[str], size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: A-Z lower-cased, words are runs of anything but ASCII white space."""
    numbers: dict[bytes, int] = {}
    flat: list[int] = []
    counts = []
    for text in texts:
        words = text.encode("utf-8", "replace").lower().split()
        counts.append(len(words))
        flat.extend([numbers.setdefault(w, len(numbers)) for w in words])
    if not flat:
        return [np.empty(0, dtype=np.uint64)] * len(texts)
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in numbers], dtype=np.uint64)
    h = np.concatenate([known[np.array(flat)], np.zeros(size - 1, dtype=np.uint64)])
    m = len(flat)
    mixed = np.zeros(m, dtype=np.uint64)
    factor = 0x9E3779B97F4A7C15
    for j in range(size):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(factor | 1) + h[j : j + m]
    mixed ^= mixed >> np.uint64(33)
    mixed *= np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(33)
    out, at = [], 0
    for n in counts:
        if n >= size:
            out.append(np.unique(mixed[at : at + n - size + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[at : at + n].tobytes(), n)], dtype=np.uint64))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        at += n
    return out


def class_key(found: np.ndarray) -> int | None:
    """A class's number: a hash of its whole set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes(), len(found))).view(np.int64)) if len(found) else None


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _classes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows of documents (kind 0) and, from every COUNTED shingles, those in two texts or more (kind 1)."""
    target = to_arrow("kind int, doc_id long, text_hash long, key long, n long")
    held = np.empty(COUNTED, dtype=np.uint64)
    total = 0

    def often() -> pa.RecordBatch:
        own = held[:total]
        own.sort()
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        times = np.diff(np.r_[first, total])
        token, times = own[first[times > 1]], times[times > 1]
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(token), dtype=np.int32)), pa.nulls(len(token), pa.int64()), pa.nulls(len(token), pa.int64()), pa.array(token.view(np.int64)), pa.array(times.astype(np.int64))], schema=target)

    for part in chunks(batches, limit=SHINGLE_BYTES):
        found = shingles(part["text"].to_pylist(), size)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(found), dtype=np.int32)), part["doc_id"], part["text_hash"], pa.array([class_key(x) for x in found], type=pa.int64()), pa.array([len(x) for x in found], type=pa.int64())], schema=target)
        for own in found:
            while len(own):
                n = min(len(own), COUNTED - total)
                held[total : total + n] = own[:n]
                total, own = total + n, own[n:]
                if total == COUNTED:
                    yield often()
                    total = 0
    if total:
        yield often()


def _prefixes(batches: Iterator[pa.RecordBatch], size: int, percent: int, often: np.ndarray) -> Iterator[pa.RecordBatch]:
    target = to_arrow("token long, key long, n int, i int")
    seen: set[int] = set()  # equal sets give equal rows: one of them in a task is enough
    for part in chunks(batches, limit=SHINGLE_BYTES):
        tokens, keys, sizes, places = [], [], [], []
        for found in shingles(part["text"].to_pylist(), size):
            key = class_key(found)
            if key is None or key in seen:
                continue
            seen.add(key)
            if len(often):
                common = often[np.minimum(np.searchsorted(often, found), len(often) - 1)] == found
                if common.any():
                    found = np.concatenate([found[~common], found[common]])
            n, p = len(found), prefix_size(len(found), percent)
            tokens.append(found[:p])
            keys.append(np.full(p, key, dtype=np.int64))
            sizes.append(np.full(p, n, dtype=np.int32))
            places.append(np.arange(p, dtype=np.int32))
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], schema=target)


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A text's set for each comparison that it takes part in."""
    target = to_arrow("lead long, salt int, role int, key long, found binary")
    out: list[list] = [[], [], [], [], []]
    total = 0
    for part in chunks(batches, limit=SHINGLE_BYTES):
        for found, key, goals in zip(shingles(part["text"].to_pylist(), size), part["key"].to_pylist(), part["goals"].to_pylist(), strict=True):
            if class_key(found) == key:  # rows that only repeat a doc_id are passed over
                raw = found.tobytes()
                for lead, salt, role in zip(*[iter(goals)] * 3, strict=True):
                    for column, value in zip(out, (lead, salt, role, key, raw), strict=True):
                        column.append(value)
                    total += len(raw)
                    if total >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pydict(dict(zip(target.names, out, strict=True)), schema=target)
                        out, total = [[], [], [], [], []], 0
    if out[0]:
        yield pa.RecordBatch.from_pydict(dict(zip(target.names, out, strict=True)), schema=target)


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come by leader, the leader's set first: only that one is held."""
    target = to_arrow("a long, b long")
    lead, own = None, np.empty(0, dtype=np.uint64)
    for part in batches:
        a, b = [], []
        for at, role, key, raw in zip(part["lead"].to_pylist(), part["role"].to_pylist(), part["key"].to_pylist(), part["found"], strict=True):
            found = np.frombuffer(raw.as_buffer(), dtype=np.uint64)
            if role == 0:
                lead, own = at, found.copy()
            elif at == lead:
                place = np.minimum(np.searchsorted(own, found), len(own) - 1)
                shared = int(np.count_nonzero(own[place] == found))
                if 100 * shared >= percent * (len(own) + len(found) - shared):
                    a.append(lead)
                    b.append(key)
        yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], schema=target)


def _null_hash() -> Column:
    """Tells texts without doc_id apart; 0 where there is a doc_id."""
    return F.when(F.col("doc_id").isNull(), F.col("text_hash")).otherwise(F.lit(0).cast("long"))


def _verified(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of stored pairs (a, b) of classes those that link. A leader with very many members is compared in several tasks."""
    many = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / MEMBERS).cast("int").alias("salts"))
    members = pairs.join(many, "a").select(F.col("b").alias("key"), F.col("a").alias("lead"), F.pmod(F.hash("b"), "salts").alias("salt"), F.lit(1).alias("role"))
    leaders = many.select(F.col("a").alias("key"), F.col("a").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    goals = members.union(leaders).groupBy("key", F.floor(F.col("salt") / GOALS).alias("nth")).agg(F.flatten(F.collect_list(F.array(F.col("lead"), F.col("salt").cast("long"), F.col("role").cast("long")))).alias("goals"))
    by_doc = stored(goals.join(firsts, "key").select(F.col("doc_id").alias("of_doc"), F.col("null_hash").alias("of_hash"), "key", "goals"), "goals")
    texts = docs.withColumn("null_hash", _null_hash()).join(checked_broadcast(by_doc), F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("null_hash") == F.col("of_hash")))
    sets = in_arrow(texts.select("text", "key", "goals"), lambda b: _sets(b, size), "lead long, salt int, role int, key long, found binary")
    sets = sets.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "role", "key")
    return in_arrow(sets, lambda b: _compare(b, percent), "a long, b long")


def _needed(n: Column, m: Column, percent: int) -> Column:
    """The overlap that makes sets of n and m similar enough."""
    return F.ceil((n + m) * percent / (100 + percent))


def _links(docs: DataFrame, size: int, percent: int, own: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, key, n) of each row and links (a, b) of classes, some twice; of those within a group only the
    ones to its leaders unless `own`."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    first = stored(in_arrow(docs, lambda b: _classes(b, size), "kind int, doc_id long, text_hash long, key long, n long"), "classes")
    nodes = first.where("kind = 0").select("doc_id", "text_hash", "key", "n")
    firsts = nodes.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("text_hash")).select("key", "doc_id", _null_hash().alias("null_hash"))

    common = first.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).where(f"n >= {OFTEN}").orderBy(F.desc("n"), "key").limit(MOST_OFTEN)
    often = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r["key"] for r in common.select("key").toLocalIterator()], dtype=np.int64).view(np.uint64)))
    rows = in_arrow(docs.select("text"), lambda b: _prefixes(b, size, percent, often.value), "token long, key long, n int, i int")
    rows = rows.repartition("token").dropDuplicates(["token", "key"])
    of_token = Window.partitionBy("token")
    rows = rows.withColumn("held", F.count("*").over(of_token)).where("held > 1").drop("held")
    # Groups: members of a shingle's list against its leaders, which are found while the list is together.
    orders = {"earliest": F.struct("i", "key"), "dealt": F.struct(F.xxhash64("key"), "key")}
    rows = rows.select("*", *[F.min_by(F.struct("key", "n", "i"), order).over(of_token).alias(name) for name, order in orders.items()])
    rows = stored(rows, "shared-prefixes")
    leaders = [rows.where(f"{x}.key != key").select(F.col(f"{x}.key").alias("a"), F.col(f"{x}.n").alias("m"), F.col(f"{x}.i").alias("j"), F.col("key").alias("b"), "n", "i") for x in orders]
    pairs = leaders[0].union(leaders[1]).where(_needed(F.col("n"), F.col("m"), percent) <= F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")))
    pairs = pairs.groupBy("a", "b", "n").count().where("100 * count >= n")  # a twentieth of the prefix; what is missed here the matrix finds
    best = Window.partitionBy("b").orderBy(F.desc("count"), "a")
    pairs = pairs.withColumn("nth", F.row_number().over(best)).where("nth <= 2").select("a", "b")
    pairs = stored(pairs, "leader-pairs")
    links = stored(_verified(pairs, docs, firsts, size, percent), "leader-links", done=[pairs])
    groups = components(links)

    # The matrix: groups by early shingle of a member; classes ask for the other groups that share one of their prefix's.
    grouped = rows.join(groups, F.col("key") == F.col("node"), "left").select("token", "key", "n", "i", F.coalesce("label", "key").alias("group"))
    grouped = stored(grouped, "grouped", done=[rows, groups])
    early = grouped.where(_needed(F.col("n"), F.col("n"), percent) <= F.col("n") - F.col("i"))
    matrix = early.groupBy("token", F.col("group").alias("other")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("i")).alias("rest"))
    least = F.greatest(F.col("low"), F.ceil(F.col("n") * percent / 100))
    may = (F.lit(own) | (F.col("group") != F.col("other"))) & (least <= F.least("n", "high")) & (_needed(F.col("n"), least, percent) <= F.least(F.col("n") - F.col("i"), F.col("rest")))
    asked = grouped.withColumnRenamed("token", "of").join(matrix, (F.col("of") == F.col("token")) & may).select("token", "other", F.col("key").alias("a"), F.col("n").alias("m"), F.col("i").alias("j"))
    members = early.select(F.col("token").alias("of"), F.col("group").alias("within"), "key", "n", "i")
    can = (F.col("key") != F.col("a")) & (F.col("n") <= F.col("m")) & (_needed(F.col("n"), F.col("m"), percent) <= F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")))
    found = asked.join(members, (F.col("token") == F.col("of")) & (F.col("other") == F.col("within")) & can)
    found = found.select(F.least("a", "key").alias("a"), F.greatest("a", "key").alias("b")).distinct()
    found = stored(found, "group-pairs", done=[grouped])
    more = _verified(found, docs, firsts, size, percent)
    return nodes, links.union(stored(more, "group-links", done=[found]))


def pairs(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All links: (a, b), a < b, of every two classes that are similar enough, and the members of the classes: doc_id,
    text_hash, key (null for texts without shingles) and n_shingles of each row. Rows of one key have equal sets."""
    nodes, links = _links(docs, size, percent, True)
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), nodes.withColumnRenamed("n", "n_shingles")


def linked(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, by_text: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text); by_text: also text_hash, xxhash64 of the text
    (null: empty), which tells rows of one doc_id apart.

    Null texts and texts without words have no shingles and are linked with nothing: component_id is their doc_id.
    Equal sets are linked. Repeated rows get a row each; a null doc_id is no component_id as long as there is another.
    """
    nodes, links = _links(docs, size, percent, False)
    labels = components(links)
    own = nodes.join(labels, F.col("key") == F.col("node"), "left").select("doc_id", "text_hash", F.coalesce("label", "key").alias("label"), "n")
    least = own.where("label IS NOT NULL").groupBy(F.col("label").alias("of")).agg(F.min("doc_id").alias("least"))
    least = stored(least, "least")  # read from a file of its own, so that the join can split a very large group
    return own.join(least, F.col("label") == F.col("of"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), *["text_hash"] * by_text)
