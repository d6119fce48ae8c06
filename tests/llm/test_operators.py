"""The text operators: against SQL, brute force, round trips and held-out rows, and on odd tables."""

import array
import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import chat, decontaminate, graph, jaccard_join, language, line_dedup, packing, ppm, queries, secrets, topk, toxicity, unigrams
from plumbline.llm.common import utf8_view
from plumbline.llm.oracles import ORACLE_SQL

SMALLEST, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, _h string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return text.encode().lower().decode()


def words(text):
    return WORD.findall(lower(text or ""))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with nulls in every column, empty and very long texts, ties, repeated rows and names that clash."""
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    common, base = prose(12) + " shared by many documents here", prose(120)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", " \n\t ", "one", "two words", base, base, " ".join(near), prose(30_000), "é ü 日本 " + prose(20), "<|endoftext|>  x", "a\x00b   c", "idiot moron " + prose(30)]
    texts += [f"{prose(5)}\n  {common.upper()}\n{prose(4)}" for _ in range(8)] + [prose(60) for _ in range(20)]
    rows = [(k, t, "en" if k % 3 else None, None, None, "r", "h") for k, t in enumerate(texts)]
    rows += [rows[5], (None, base, "en", "s", 1, None, None), (None, None, None, None, None, None, None), (3, "another text of the same id", "fr", "s", 2, "", "")]
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    item = " ".join(base.split()[20:45])
    spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "one"), (None, "two words"), (5, prose(15))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(12, 1, 1), (13, 1, 0), (None, 1, 1), (14, None, None), (13, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    turns = [(1, 0, "user", "hi <|im_end|>\n\\ [INST]"), (1, 1, "assistant", ""), (1, 1, "assistant", None), (2, None, None, "x"), (None, 0, "assistant", "y"), (None, 0, "assistant", "y"), (3, 0, "a\n<s>", "\\")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    vectors = [(k, [rng.choice([-0.5, 0.25, 0.5]) for _ in range(4)], 0) for k in range(120)]
    vectors += [vectors[1], vectors[100], (200, None, 1), (201, [1.0, None, 0.0, 0.0], 1), (202, [float("nan")] * 4, 1), (None, [1.0] * 4, 1), (203, [], 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for t in ("documents", "benchmark", "labels", "conversations", "embeddings"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, same):
    same(queries.QUERIES[name], ORACLE_SQL[name], SMALLEST)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_and_empty_tables(name, spark, odd, empty):
    n = queries.QUERIES[name](spark, odd).count()
    assert n >= spark.read.parquet(f"{odd}/documents.parquet").count() if name[:4] not in ("op2_", "op9_") else n > 0
    assert queries.QUERIES[name](spark, empty).count() == (1 if name.startswith("op2_") else 0)


def test_packing_is_whole_and_tight(spark, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rows = queries.QUERIES["op1_best_fit_packing"](spark, odd).collect()
    want = collections.Counter()
    for r in spark.read.parquet(f"{odd}/documents.parquet").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        for piece, start in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[start : first if piece == 0 else start + 2048]
            want[r.doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    at = collections.defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for parts in at.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert len(at) <= 1 + sum(r.length for r in rows) / 2048 * 1.1


def test_two_that_fit_replace_the_smallest():
    # greedy takes 60 and 30; 25 + 15 fill the gap of 40 that 30 leaves
    bins = packing.pack_histogram({60: 1, 30: 1, 25: 1, 15: 1}, 100)
    assert bins[0] == (1, [(60, 1), (25, 1), (15, 1)])


def test_sequences_hold_the_ids(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    packed = packing.pack_documents(docs, queries.tokenizer_path(), keep_ids=True)
    assert all(len(r.ids) == 4 * r.length for r in packing.sequences(packed).collect())


def test_ids_are_the_tokenizers():
    t = packing.Tokenizer(queries.tokenizer_path())
    assert t.fast is not None
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "word", "don't", "'s", "12", "é", "日本", "<|endoftext|>", "!?", "\u00a0", "\u2028", "\x00", "\U0001f600", "x" * 300]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert t.encode(text) == t.slow(text)
    for low in [*range(0, 0x3400, 0x400), 0xF900, 0xFC00, 0x10000, 0x1F000, 0xE0000]:  # between letters, digits and spaces
        text = "".join(f"a{chr(c)}1 {chr(c)}" for c in range(low, low + 0x400))
        assert t.encode(text) == t.slow(text)


def test_very_long_runs_are_encoded():
    t = packing.Tokenizer(queries.tokenizer_path())
    for unit in (" ", "\n", "a", "1", "."):
        long = unit * 1_200_000 if unit.isspace() else unit * 50_000
        ids = t.encode(f"x{long}y")
        assert t.tokenizer.decode(list(array.array("I", ids))) == f"x{long}y"


def test_chat_round_trip():
    t = chat.Template()
    rng = random.Random(9)
    parts = [*chat.CONTROLS, "\\", "\n", "x", "<", "|im_end|>", "é"]
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "a\nb", "\\"]), "".join(rng.choice(parts) for _ in range(rng.randrange(8)))) for _ in range(rng.randrange(1, 5))]
        text, spans = t.format(turns)
        assert t.parse(text) == turns
        assert [t.unescape(text[s:e]) for s, e in spans] == [x for r, x in turns if r == "assistant"]
        assert text.count(t.begin) == len(turns)


def test_chat_query_reads_back(spark, odd):
    got = {r.conv_id: r for r in queries.QUERIES["op2_chat_formatting"](spark, odd).collect()}
    said = "</s>[INST] ok [/INST]"
    assert got[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[-1].loss_chars == len(said)
    assert (got[1].n_turns, got[None].n_turns, got[2].n_turns) == (3, 2, 1)
    assert got[None].loss_sha256 == hashlib.sha256(b"yy").hexdigest()


def test_reply_trees(spark):
    # 1 - 2 - (3, 4 - 5), and an orphan 9
    rows = [(7, 1, None, 0.0), (7, 2, 1, 0.0), (7, 3, 2, 0.9), (7, 4, 2, 0.1), (7, 5, 4, 0.2), (7, 9, 8, None)]
    m = spark.createDataFrame([(t, i, p, "user", f"m{i}", s) for t, i, p, s in rows], "tree long, id long, parent long, role string, text string, score double")
    got = chat.format_trees(m, 2).collect()
    assert {(r.leaf, r.rank, tuple(x for _, x in chat.Template().parse(r.formatted))) for r in got} == {(3, 1, ("m1", "m2", "m3")), (5, 2, ("m1", "m2", "m4", "m5"))}


def brute_groups(docs):
    sets = []
    for _, text in docs:
        w = words(text)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    links, root = [0] * len(docs), list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    at = collections.defaultdict(set)
    for k, s in enumerate(sets):
        for x in s:
            at[x].add(k)
    for a, b in {(min(p, q), max(p, q)) for group in at.values() for p in group for q in group if p != q}:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a], links[b] = links[a] + 1, links[b] + 1
            root[max(find(a), find(b))] = min(find(a), find(b))
    ids = collections.defaultdict(list)
    for k, (doc, _) in enumerate(docs):
        ids[find(k)].append(doc)
    return [(doc, min((i for i in ids[find(k)] if i is not None), default=None), links[k]) for k, (doc, _) in enumerate(docs)]


@pytest.mark.parametrize("folder", ["odd", SMALLEST])
def test_jaccard_join_against_brute_force(spark, odd, folder):
    folder = odd if folder == "odd" else folder
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = queries.QUERIES["op3_ngram_jaccard_join"](spark, folder).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, got)) == sorted(map(key, brute_groups(docs)))


def test_large_groups_are_dealt_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"b{k}" for k in range(150)]

    def copy():
        w = list(base)
        for _ in range(3):
            w[rng.randrange(150)] = f"x{rng.random()}"
        return " ".join(w)

    docs = [(k, copy()) for k in range(90)] + [(k, " ".join(f"z{rng.randrange(10**6)}" for _ in range(40))) for k in range(100, 140)]
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "CLUSTER_BLOCK", 16)
    got = jaccard_join.similarity_groups(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "class_id", "n_links")
    assert sorted(map(tuple, got.collect())) == sorted(brute_groups(docs))


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}


def test_languages_held_out(spark):
    got = queries.QUERIES["op4_language_id"](spark, SMALL).where("held_out").join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] >= 0.97 and 0 <= r[1] <= r[2] <= 1


def test_language_of_texts_without_letters(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 _ !"), (4, "a")], "doc_id long, text string")
    model = language.fit_languages(spark.createDataFrame([("the and of", "en"), ("le la des", "fr"), ("und der das", "de")], "text string, lang string"))
    assert {r.doc_id: r.lang_pred for r in language.predict_languages(docs, model).collect()}[3] == "und"
    assert [r.lang_pred for r in language.predict_languages(docs, model).orderBy("doc_id").collect()][:3] == ["und"] * 3


def brute_windows(text, items, size=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        i = words(t)
        n = min(size, len(i))
        wins = {tuple(i[k : k + n]) for k in range(len(i) - n + 1)} if i else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in wins:
                hit |= set(range(k, k + n))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_contamination_of_odd_tables(spark, odd):
    items = [tuple(r) for r in spark.read.parquet(f"{odd}/benchmark.parquet").collect()]
    want = [(r.doc_id, *brute_windows(r.text, items)) for r in spark.read.parquet(f"{odd}/documents.parquet").collect()]
    got = decontaminate.contamination(spark.read.parquet(f"{odd}/documents.parquet"), spark.read.parquet(f"{odd}/benchmark.parquet")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got) == sorted((str(a), b, c, d) for a, b, c, d in want)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SMALLEST}/documents.parquet"), spark.read.parquet(f"{SMALLEST}/benchmark.parquet")
    one = sorted(map(str, decontaminate.contamination(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 400)
    assert one == sorted(map(str, decontaminate.contamination(docs, items).collect()))


def test_toxicity(spark):
    got = queries.QUERIES["op6_toxicity"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (got.predicted == (got.score >= 0.3)).all() and got.score.between(0, 1).all()
    assert held[held.toxic == 1].predicted.mean() >= 0.5 and held[held.toxic == 0].predicted.mean() <= 0.05


def test_without_labels_all_documents_are_kept(spark, odd):
    docs, labels = spark.read.parquet(f"{odd}/documents.parquet"), spark.read.parquet(f"{odd}/labels.parquet")
    absent = labels.withColumn("doc_id", F.lit(10**9).cast("long"))
    for none in (labels.limit(0), absent, labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert toxicity.keep_civil(docs, none).count() == docs.count() > 0


def test_labels_without_documents_take_no_place(spark):
    docs = spark.createDataFrame([(k, f"{'idiot moron' if k % 2 else 'kind words'} t{k}") for k in range(20)], "doc_id long, text string")
    labels = spark.range(20).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    absent = spark.range(1000, 3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("toxic"))
    want, got = toxicity.fit_toxicity(docs, labels, most=20), toxicity.fit_toxicity(docs, labels.unionByName(absent), most=20)
    assert len(want[0]) and all(np.array_equal(a, b) for a, b in zip(want, got, strict=True))


def test_feature_rows_do_not_reach_over_texts():
    alone = [toxicity.feature_rows(*utf8_view(pa.array([t])))[0].tolist() for t in ("a b c", "", "d", "A  B c")]
    together = [r.tolist() for r in toxicity.feature_rows(*utf8_view(pa.array(["a b c", "", "d", "A  B c"])))]
    assert alone == together and alone[0] == alone[3] and len(alone[0]) == 6  # three words, two pairs, one skip


def test_line_dedup_of_odd_tables(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    holders = collections.defaultdict(set)
    low = line_dedup.NO_ID
    for doc, text in rows:
        for line in text.split("\n"):
            if len(line.strip(line_dedup.BLANK)) >= 40:
                holders[line_dedup.line_key(line)].add(low if doc is None else doc)
    want = []
    for doc, text in rows:
        kept = [x for x in text.split("\n") if not (len(h := holders.get(line_dedup.line_key(x), ())) >= 5 and max(h) != (low if doc is None else doc))]
        want.append((str(doc), text.count("\n") + 1, text.count("\n") + 1 - len(kept), "\n".join(kept)))
    got = line_dedup.drop_repeated_lines(docs).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in got) == sorted(want)
    assert sum(w[2] for w in want) >= 7


def test_lines_that_span_partitions(spark):
    line = "a line that very many of the documents have in common"
    docs = spark.createDataFrame([(k, f"{line}\nown line {k}, which no other document has at all\n{line if k % 7 == 0 else ''}") for k in range(400)], "doc_id long, text string")
    got = line_dedup.drop_repeated_lines(docs).agg(F.sum("n_dropped"), F.max(F.when(F.col("n_dropped") == 0, F.col("doc_id")))).first()
    assert tuple(got) == (399 + len(range(0, 399, 7)), 399)


def test_ppm_against_brute_force():
    rng = random.Random(2)
    train = ["".join(rng.choice("abé ") for _ in range(rng.randrange(0, 60))) for _ in range(30)]
    order = 3
    data, offsets = utf8_view(pa.array(train))
    symbols, places, _ = ppm._stream(data, offsets, order)
    grams = {n: np.unique(ppm._grams(symbols, places, n), return_counts=True) for n in range(1, order + 2)}
    model = ppm.PpmModel.of(order, grams)
    counts = collections.defaultdict(collections.Counter)
    for text in train:
        s = bytes([ppm.START]) * order + text.encode() + bytes([ppm.END])
        for k in range(order, len(s)):
            for n in range(order + 1):
                counts[s[k - n : k]][s[k]] += 1

    def brute(text):
        s, total = bytes([ppm.START]) * order + text.encode() + bytes([ppm.END]), 0.0
        for k in range(order, len(s)):
            excluded = set()
            for n in range(order, -1, -1):
                seen = {x: c for x, c in counts.get(s[k - n : k], {}).items() if x not in excluded}
                if not seen:
                    continue
                below = sum(seen.values()) + len(seen)
                if s[k] in seen:
                    total += math.log10(seen[s[k]] / below)
                    break
                total += math.log10(len(seen) / below)
                excluded |= seen.keys()
            else:
                total -= math.log10(256 - len(excluded))
        return total

    texts = ["", "ab", "zzz", "aé b", train[3], "日本a", *train[:10]]
    assert model.log10(*utf8_view(pa.array(texts))) == pytest.approx([brute(t) for t in texts], abs=1e-3)


def test_ppm_scores_by_all_counted_grams(spark, monkeypatch):
    rng = random.Random(12)
    train = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(0, 80))) for _ in range(40)]
    scored = [*train[:8], "", None, "zzz", "ab cdé", "日本a"]
    grams = {}
    data, offsets = utf8_view(pa.array(train))
    symbols, places, _ = ppm._stream(data, offsets, ppm.ORDER)
    for n in range(1, ppm.ORDER + 2):
        grams[n] = np.unique(ppm._grams(symbols, places, n), return_counts=True)
    want = ppm.PpmModel.of(ppm.ORDER, grams).log10(*utf8_view(pa.array(scored)))
    texts, docs = spark.createDataFrame([(t,) for t in train], "text string"), spark.createDataFrame(list(enumerate(scored)), "k long, text string")
    monkeypatch.setattr(ppm, "PART", 50)
    for head in (0, 60, 10**6):
        got = ppm.score_texts(docs, ppm.fit_ppm(texts, ppm.ORDER, head)).orderBy("k").collect()
        assert [r.ppm_log10 for r in got] == pytest.approx(want.tolist(), abs=1e-6)


def test_adaptive_scores_are_probabilities():
    # all texts of up to two symbols out of the first steps can't have more than probability 1
    assert sum(10 ** ppm.adaptive_log10(t, 2) for t in ["", *map(chr, range(128))]) <= 1
    assert ppm.adaptive_log10("ab" * 40, 3) > ppm.adaptive_log10("".join(chr(33 + k) for k in range(80)), 3)


def test_scores_beat_the_uniform_and_counts_are_exact(spark, odd):
    got = queries.QUERIES["op8_lm_scoring"](spark, odd).collect()
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{odd}/documents.parquet").collect()]
    held = lambda doc: zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0
    counts = collections.Counter(t for doc, text in rows if not held(doc) for t in unigrams.tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(doc), held(doc), len(x := unigrams.tokens(text)), sum(counts[t] > 0 for t in x), n, round(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in x), 4)) for doc, text in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_rare_tokens_meet_their_counts(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet").select(F.monotonically_increasing_id().alias("k"), "text")
    a, b = (sorted((r.k, r.n_known, round(r.base_score, 6)) for r in unigrams.score_unigrams(docs, docs.select("text"), head).collect()) for head in (5, 10**6))
    assert a == b


def test_top_k_against_brute_force(spark, odd):
    vectors = topk.usable(spark.read.parquet(f"{odd}/embeddings.parquet"))
    rows = [(r.vec_id, tuple(r.v)) for r in vectors.collect()]
    want = []
    for q, v in {r for r in rows if r[0] % 50 == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), i) for i, x in rows if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in queries.QUERIES["op9_exact_top_k"](spark, odd).collect()) == sorted(want)


def test_top_k_of_rows_that_repeat_and_of_long_vectors(spark):
    v = spark.createDataFrame([(1, [3, 0]), (1, [3, 0]), (2, [1, 0]), (50, [1, 1])], "vec_id long, v array<long>")
    got = topk.pivot_top_k(v, v.where("vec_id = 50"), 3).collect()
    assert sorted(map(tuple, got)) == [(50, 1, 1, 3), (50, 2, 1, 3), (50, 3, 2, 1)]
    with pytest.raises(ValueError):
        topk.pivot_top_k(spark.createDataFrame([(1, [2**27])], "vec_id long, v array<long>"), v)


def test_base_spans_against_plain_patterns():
    rng = random.Random(3)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "passwd", " = ", ":", "=", '"', "'", "abcdefgh1", "short", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef" * 2, " ", "\n", "ſecret", "é"]
    plain = (
        ("assign", re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    )
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        want = sorted(((kind, m.start(), m.end()) for kind, p, good in plain for m in p.finditer(text) if good(m)), key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        assert secrets.base_spans(text) == want
        assert {*want} <= {*secrets.secret_spans(text)}


def test_constants_are_propagated():
    text = 'k = "Zx81kQ0pLw3v"\nother = "plain text"\nconfig.db_password = k\nauth_key: "ab12" + "Cd34eF90"\npassword = "changeme"'
    found = [text[s:e] for s, e, _ in secrets.literal_spans(text)]
    assert found == ["Zx81kQ0pLw3v", "ab12", "Cd34eF90"]
    assert "Zx81" not in secrets.redact(text)


def test_lexer_has_no_length_limits():
    rng = random.Random(5)
    secret = lambda n: "".join(rng.choice("abcdefXYZ0123456789") for _ in range(n))
    found = lambda text: [text[s:e] for s, e, _ in secrets.literal_spans(text)]
    long, short, parts = secret(10_000), secret(20), [secret(12) for _ in range(30)]
    assert found(f'private_key = "{long}"') == [long] and found(f"private_key = '{long}'") == [long]
    assert found(f"private_key = {long}") == [long] and long[-50:] not in secrets.redact(f"private_key = {long}")
    assert found(f'db_credential{" " * 40}={" " * 40}"{short}"') == [short]
    assert found("private_key = " + f"{' ' * 20}+{' ' * 20}".join(f'"{p}"' for p in parts)) == parts
    assert found(f'credential_{"x" * 100} = "{short}"') == [short] and found(f'"credential_{"x" * 100}": "{short}"') == [short]


def test_lexer_is_linear():
    for unit in ("a", "a ", " ", "1.", "-", '"', "\\", 'a="', "a='\\", '+"b"', "a=", "a:="):
        start = time.perf_counter()
        secrets.literal_spans("k = " + unit * 200_000)
        assert time.perf_counter() - start < 10, unit


def test_pipeline_against_its_operators(spark, odd, empty):
    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = stage(spark, kept, SMALLEST).cache()
        assert kept.columns == docs.columns and 0 < kept.count() <= before, name
    final = {r.doc_id for r in corpus_pipeline.run(spark, SMALLEST).select("doc_id").distinct().collect()}
    assert final == {r.doc_id for r in kept.select("doc_id").collect()}
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert all(links == 0 for _, _, links in brute_groups(rows))
    items = [tuple(r) for r in spark.read.parquet(f"{SMALLEST}/benchmark.parquet").collect()]
    assert all(brute_windows(t, items)[1] == 0 for _, t in rows)
    assert corpus_pipeline.run(spark, odd).count() > 0 and corpus_pipeline.run(spark, empty).count() == 0
