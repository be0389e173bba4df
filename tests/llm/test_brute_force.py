"""Each operator against a plain version of its contract, on odd rows and on a small random corpus."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidemill.llm import jaccard, licenses, mixing, order_minhash, packing, quality, repeats, token_counts, token_files, toxicity
from tidemill.llm.word_ids import WordIds, default_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


@pytest.fixture(scope="module")
def corpus(spark, odd):
    r = random.Random(5)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(r.choices(words, k=n)) + r.choice(["", ".", "!!"])
    shared = text(90)
    texts = [text(r.randint(1, 200)) for _ in range(40)]
    texts += [f"{text(20)} {shared} {text(30)}" for _ in range(6)]
    for t in texts[:12]:
        w = t.split(" ")
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    rows = [(1000 + i, t, "en", f"s{i % 4}", len(t), None, None, None) for i, t in enumerate(texts)]
    return odd.union(spark.createDataFrame(rows, odd.schema)).cache()


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def text_hash(text):
    """xxhash64 as Spark has it."""
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).view(np.int64))


def pairs(corpus):
    return [(r["doc_id"], r["text"] or "") for r in corpus.collect()]


def test_word_ids_equal_the_tokenizer(corpus):
    encoder = WordIds(default_path())
    texts = [t for _, t in pairs(corpus)] + ["a!!, b' d'e. x_y __ é, è! ñ; ß… a“b”. 3.5, 12% <|ENDOFTEXT|> q<|endoftext|>.", "İ İ ΣΣ é́, ½ ²³", "(a) a). -b-"]
    for text, raw in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_counts(spark, corpus, empty):
    vocabulary = ["a", "ab", "abc", "##a", "##b", "##bcd", "##cd", "b", "##"]
    automaton, known = token_counts.Automaton(vocabulary), set(vocabulary)

    def greedy(word):
        n = at = 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if (word[at:e] if not at else "##" + word[at:e]) in known), None)
            if end is None:
                return 0
            n, at = n + 1, end
        return n

    r = random.Random(1)
    for _ in range(3000):
        word = "".join(r.choice("abcd") for _ in range(r.randint(1, 8)))
        assert automaton.count(word) == greedy(word), word
    vocabulary = set(token_counts.vocabulary_of(default_path()))
    mark, longest = token_counts.MARK, max(map(len, vocabulary))
    pieces = {}

    def plain(word):
        n = at = 0
        while at < len(word):
            end = next((e for e in range(min(len(word), at + longest), at, -1) if (word[at:e] if not at else mark + word[at:e]) in vocabulary), None)
            if end is None:
                return 0
            n, at = n + 1, end
        return n

    expected = []
    for doc_id, text in pairs(corpus):
        words = [w.decode() for w in text.lower().encode().split()]
        for w in words:
            if w not in pieces:
                pieces[w] = plain(w)
        none = sum(pieces[w] == 0 for w in words)
        expected.append((doc_id, len(words), sum(pieces[w] for w in words) + none, none))
    assert rows_of(token_counts.counts(corpus, default_path()), "doc_id", "n_words", "n_tokens", "n_unknown") == sorted(expected, key=repr)
    assert token_counts.counts(empty, default_path()).count() == 0


def covered(sequence, window, seen):
    gone = bytearray(len(sequence))
    for i in range(len(sequence) - window + 1):
        if seen[sequence[i : i + window]] > 1:
            gone[i : i + window] = b"\1" * window
    return bytes(gone)


def plain_removed(texts, window, passage):
    """Per text: bytes, removed, spans, digest of the rest, words in passages, and the text without both kinds."""
    docs = [t.encode() for t in texts]
    words = [tuple(WORD.findall(t)) for t in texts]
    seen = Counter(d[i : i + window] for d in docs for i in range(len(d) - window + 1))
    told = Counter(w[i : i + passage] for w in words for i in range(len(w) - passage + 1))
    out = []
    for t, d, w in zip(texts, docs, words, strict=True):
        gone, inside = covered(d, window, seen), covered(w, passage, told)
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        both, at = bytearray(gone), [(len(t[: m.start()].encode()), len(t[: m.end()].encode())) for m in WORD.finditer(t)]
        for m in re.finditer(b"\1+", inside):
            first, last = at[m.start()][0], at[m.end() - 1][1]
            both[first:last] = b"\1" * (last - first)
        rest = bytes(x for x, g in zip(d, both, strict=True) if not g).decode("utf-8", "ignore")
        out.append(((len(d), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest(), sum(inside)), rest))
    return out


def test_repeats(corpus, empty):
    expected = [(d, *found) for (d, _), (found, _) in zip(pairs(corpus), plain_removed([t for _, t in pairs(corpus)], 400, 50), strict=True)]
    assert rows_of(repeats.removed(corpus), "doc_id", *repeats.ADDED) == sorted(expected, key=repr)
    assert any(f[2] == 0 and f[5] > 0 for f in expected) and any(f[2] > 0 for f in expected)
    assert repeats.removed(empty).count() == 0


def test_repeats_with_a_common_core_and_long_texts_in_parts(spark, corpus, monkeypatch):
    monkeypatch.setattr(repeats, "ENTRIES", 2)
    docs = corpus.where("doc_id >= 1000").select("doc_id", "text")
    expected = [(d, *found) for (d, _), (found, _) in zip(pairs(docs), plain_removed([t for _, t in pairs(docs)], 60, 20), strict=True)]
    assert rows_of(repeats.removed(docs, 60, 32, 20), "doc_id", *repeats.ADDED) == sorted(expected, key=repr)
    r = random.Random(8)
    texts = [bytes(r.choices(b"abcdefgh", k=n)) for n in (3000, 50, 900)]
    texts.append(texts[0][100:2900])
    for unit, window, span in ((1, 40, 16), (8, 20, 8)):
        raw = [t if unit == 1 else b"".join(b"%08d" % x for x in t) for t in texts]
        monkeypatch.setattr(repeats, "PARSE_BYTES", 500 * unit)
        starts = []
        for group in repeats._parts(raw, window, unit):
            text, lo, n, at = repeats.parse([x for _, _, x in group], window, span, unit)
            assert ((lo <= at) & (at < lo + n - 1 + span)).all()
            starts += [(group[t][0], group[t][1] + a + i) for t, a, k in zip(text.tolist(), lo.tolist(), n.tolist(), strict=True) for i in range(k)]
        assert sorted(starts) == [(i, k) for i, t in enumerate(texts) for k in range(len(t) - window + 1)]


def test_quality(corpus, empty):
    expected = []
    for doc_id, t in pairs(corpus):
        w = WORD.findall(t)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        expected.append((doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    found = quality.quality(corpus).cache()
    assert rows_of(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(expected, key=repr)
    assert not found.where("base_failed AND kept").count() and not found.where("kept IS NULL").count()
    assert quality.quality(empty).count() == 0 and quality.kept(empty).count() == 0


def test_outliers_are_rejected_and_clean_rows_stay(spark):
    r = random.Random(2)
    text = lambda mark: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) + (r.choice("#$%&") * 3 if mark else r.choice(["", "", "", ","])) for _ in range(r.randint(60, 300)))
    rows = [(i, text(i % 12 == 0), "en", "s0") for i in range(600)]
    found = {x["doc_id"]: x["kept"] for x in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(found[i] for i in range(0, 600, 12)) and all(found[i] for i in range(600) if i % 12)


def test_mixing(corpus, empty):
    found = mixing.copies(corpus).cache()
    for row in found.collect():
        assert row["size"] == len(WORD.findall(row["text"] or "")) and 0 <= row["n_copies"] <= 3
    sources = {r["source"]: (r["source_size"], r["target"]) for r in found.collect()}
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(v for v, _ in sources.values()), set()
    while True:
        left, w = total - sum(3 * sources[s][0] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: 3.0 * sources[s][0] if s in full else left * weight[s] / w for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sources[s][0]}
        if not over:
            break
        full |= over
    for s in order:
        assert sources[s][1] == pytest.approx(target[s])
    assert mixing.mixed(corpus).count() == sum(r["n_copies"] for r in found.collect())
    assert mixing.copies(empty).count() == 0


def test_licenses(corpus, empty):
    def contained(block, index):
        return sorted((label, sum(w in block for w in words) / len(words)) for label, words, need in index.templates if sum(w in block for w in words) >= need)

    index = licenses.Index(frequency={b"license": 9, b"the": 90})
    r = random.Random(4)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in t.encode().split()} | {b"x", b"y"})
    for _, text in licenses.TEMPLATES:
        for _ in range(60):
            block = frozenset(r.sample(vocabulary, 6) + [w for w in text.encode().split() if r.random() < 0.9])
            assert sorted(index.find(block)) == contained(block, index)
    assert licenses.places("x cc by cc by y".split() and [w.encode() for w in "x cc by cc by y all rights reserved".split()]) == [(1, "cc-by"), (3, "cc-by"), (6, "reserved")]
    assert licenses.scan(corpus).count() == corpus.count() and licenses.scan(empty).count() == 0


def test_order_minhash(corpus, empty):
    docs = sorted(pairs(corpus), key=lambda d: (d[0] is None, -(d[0] or 0), -text_hash(d[1])))
    expected = []
    for i, (doc_id, t) in enumerate(docs):
        after, half = docs[(i + 1) % len(docs)][1], len(t) // 2
        expected.append((doc_id, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    found = order_minhash.fingerprints(corpus).cache()
    assert {(a, b) for a, b, _ in expected} == {(r["doc_id"], r["n_chars"]) for r in found.collect()}
    assert rows_of(found, "doc_id", "n_chars", "edited_sha256") == sorted(expected, key=repr)
    assert rows_of(order_minhash.fingerprints(corpus, 3000), *found.columns) == rows_of(found, *found.columns)  # many ranges
    copies = {r["fingerprint"] for r in found.where("doc_id IN (5, 6)").collect()}
    assert len(copies) == 1 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found.collect())
    assert order_minhash.fingerprints(empty).count() == 0


def test_packing(corpus, empty):
    encoder = WordIds(default_path())
    ids = [(d, np.frombuffer(raw + (2).to_bytes(4, "little"), "<u4")) for (d, t), raw in zip(pairs(corpus), encoder.encode([t for _, t in pairs(corpus)]), strict=True)]
    found = packing.packed(corpus, default_path(), 2, 256).collect()
    assert sum(r["length"] for r in found) == sum(len(x) for _, x in ids)
    known = Counter((d, s, len(x[s : s + 256]), zlib.crc32(x[s : s + 256].tobytes()), len(x)) for d, x in ids for s in range(0, len(x), 256))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == known
    by_sequence = {}
    for r in sorted(found, key=lambda r: r["offset"]):
        assert r["offset"] == by_sequence.get(r["sequence_id"], 0)
        by_sequence[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by_sequence.values()) <= 256 and sum(by_sequence.values()) > 0.9 * 256 * (len(by_sequence) - 1)
    assert packing.packed(empty, default_path(), 2).count() == 0


def test_nnls():
    r = np.random.default_rng(0)
    a, x = r.random((12, 30)), np.maximum(r.normal(size=30), 0)
    found = packing.nnls(a, a @ x)
    assert (found >= 0).all() and np.linalg.norm(a @ found - a @ x) < 1e-6


def test_toxicity(spark, empty):
    r = random.Random(6)
    text = lambda bad: " ".join(r.choices(["the", "of", "lorem", "ipsum", "dolor", "sit"], k=40) + (["idiot", "blarg"] if bad else []))
    rows = [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(900)] + [(1000, None, 0), (1001, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs.select("doc_id", "toxic"))
    found = {x["doc_id"]: x for x in toxicity.scored(docs, model).collect()}
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in found)
    assert all(found[i]["predicted"] == y == (found[i]["score"] >= 0.7) for i, _, y in rows if found[i]["held_out"])
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(y) >= 0).all()
    assert toxicity.train(docs, docs.select("doc_id", "toxic"), rows=50).known
    assert toxicity.train(docs, docs.select("doc_id", "toxic"), most_bytes=0).scores(["x"]).tolist() == [0.0]
    none = toxicity.train(empty, empty.selectExpr("doc_id", "1 AS toxic"))
    assert {r["score"] for r in toxicity.scored(docs, none).collect()} == {0.0}


def test_token_files(corpus, empty):
    encoder = WordIds(default_path())
    docs = sorted(pairs(corpus), key=lambda d: (d[0] is not None, d[0] or 0, text_hash(d[1])))
    expected, start = [], 0
    for (doc_id, _), raw in zip(docs, encoder.encode([t for _, t in docs]), strict=True):
        raw += (2).to_bytes(4, "little")
        expected.append((doc_id, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    for size in (1 << 24, 4000):
        assert rows_of(token_files.token_files(corpus, default_path(), 2, size), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=repr)
    assert token_files.token_files(empty, default_path()).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 31])
def test_bit_packing_and_random_access(bits):
    r = np.random.default_rng(bits)
    ids = r.integers(0, 1 << bits, 1003).astype("<u4")
    assert (token_files.unpack(token_files.pack(ids, bits), len(ids), bits) == ids).all()
    parts = [ids[:10].tobytes(), b"", ids[10:].tobytes()]
    file = token_files.PackedFile(token_files.file_bytes([1, None, 3], parts, bits, block_ids=64))
    assert (file.ids(100, 777) == ids[100:777]).all() and len(file.document(1)) == 0
    assert [(d, at, len(x)) for d, at, x in file.documents()] == [(1, 0, 10), (None, 10, 0), (3, 10, 993)]


def test_jaccard(corpus, empty):
    docs = pairs(corpus)
    sets = []
    for _, t in docs:
        w = WORD.findall(t.translate(FOLD))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    expected = [(d, len(s), least.get(find(i), d)) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]
    assert rows_of(jaccard.linked(corpus), "doc_id", "n_shingles", "component_id") == sorted(expected, key=repr)
    assert jaccard.linked(empty).count() == 0


def test_toxicity_on_odd_rows(corpus):
    """Scores of whole texts equal the model's own, whatever the rows; a repeated doc_id is fitted once."""
    labels = corpus.selectExpr("doc_id", "CAST(text LIKE '%edited%' AS int) AS toxic").union(corpus.selectExpr("doc_id", "NULL"))
    model = toxicity.train(corpus, labels)
    expected = []
    for doc_id, text in pairs(corpus):
        score = float(model.scores([text])[0])
        expected.append((doc_id, zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1, score, int(score >= 0.7)))
    assert rows_of(toxicity.scored(corpus, model), "doc_id", "held_out", "score", "predicted") == sorted(expected, key=repr)


def test_license_scan_by_brute_force(spark, corpus):
    """Every template against every block, with plain sets."""
    r = random.Random(9)
    templates = [(label, set(text.split())) for label, text in licenses.TEMPLATES]
    lines = []
    for _, text in licenses.TEMPLATES:
        for _ in range(6):
            words = [w for w in text.split() if r.random() < 0.95] + r.choices(["x", "nc", "sa", "lesser", "3", "2"], k=r.randint(0, 2))
            r.shuffle(words)
            lines.append(" ".join(words))
    texts = ["\n".join(r.choices(["", "plain words here", *lines], k=r.randint(1, 5))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(corpus.select("doc_id", "text"))
    expected = []
    for doc_id, text in pairs(docs):
        folded = re.sub(r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f]", " ", text.translate(FOLD))
        words, held = folded.split(), []
        for paragraph in re.split(r"\n(?:[ ]*\n)+", folded):
            rows = [set(line.split()) for line in paragraph.split("\n") if line.split()]
            held += rows + ([set().union(*rows)] if len(rows) > 1 else [])
        found, score = set(), 0.0
        for label, own in templates:
            siblings = [o for other, o in templates if other != label and len(own & o) >= 0.85 * min(len(own), len(o)) - 1e-9]
            for block in held:
                if len(own & block) >= 0.85 * len(own) - 1e-9 and all(own - o <= block for o in siblings) and not any(own <= o and o - own and o - own <= block for o in siblings):
                    found.add(label)
                    score = max(score, len(own & block) / len(own))
        at = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        base = {label for _, label in at}
        expected.append((doc_id, len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted(base)), ",".join(sorted(base | found)), round(1.0 if at else score, 9)))
    got = [(*x[:-1], round(x[-1], 9)) for x in rows_of(licenses.scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_pipeline(spark, corpus, empty):
    """Each stage's rows against a plain version on the same input; the verdicts of the first against the operator's."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: Counter((r["doc_id"], r["text"] or "") for r in df.collect())
    kept = stages["quality rules"](spark, corpus, "")
    assert texts(kept) == texts(corpus.join(quality.quality(corpus).where("kept").select("doc_id").distinct(), "doc_id"))

    near = stages["n-gram Jaccard join"](spark, corpus, "").cache()
    docs = pairs(corpus)
    sets = []
    for _, t in docs:
        w = WORD.findall(t.translate(FOLD))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for g, (d, _) in zip(group, docs, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    stay = {(d, t) for g, (d, t) in zip(group, docs, strict=True) if d is not None and least[g] == d}
    assert texts(near) == Counter(stay) + Counter((d, t) for d, t in docs if d is None)

    cut = stages["suffix-array dedup"](spark, corpus, "")
    assert texts(cut) == Counter((d, rest) for (d, t), (_, rest) in zip(docs, plain_removed([t for _, t in docs], 400, 50), strict=True))
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    mixed = stages["mixing sources to target weights"](spark, corpus, "")
    wanted = Counter()
    for r in mixing.copies(corpus).collect():
        wanted[(r["doc_id"], r["text"] or "")] += r["n_copies"]
    assert texts(mixed) == +wanted

    encoder = WordIds(default_path())
    packed = stages["packing"](spark, corpus, "").collect()
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in packed if r["start"] == 0) == Counter((d, len(raw) // 4 + 1) for (d, _), raw in zip(docs, encoder.encode([t for _, t in docs]), strict=True))
    rows = empty
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, "")
        assert rows.columns == list(corpus_pipeline.COLUMNS)
    assert corpus_pipeline.STAGES[-1][1](spark, rows, "").count() == 0
