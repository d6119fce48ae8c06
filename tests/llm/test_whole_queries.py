"""Whole queries and pipeline stages against brute force, on the odd tables; names that clash; learning by language."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import chat, decontaminate, jaccard_join, language, line_dedup, packing, ppm, queries, secrets, toxicity
from plumbline.llm.common import utf8_view
from tests.llm.test_operators import SMALLEST, brute_groups, brute_windows, empty, odd  # noqa: F401  fixtures

LARGER = "/root/testdata/sf0.1"
LOW = line_dedup.NO_ID


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(doc, n):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % n


@pytest.mark.parametrize("folder", ["odd", SMALLEST])
def test_chat_query(spark, odd, folder):  # noqa: F811
    rows = [tuple(r) for r in spark.read.parquet(f"{odd if folder == 'odd' else folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    talks = collections.defaultdict(list)
    for conv, turn, role, text in [*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)]:
        talks[conv].append((turn is not None, turn or 0, role is not None, (role or "").encode(), text is not None, (text or "").encode()))
    want = []
    for conv, turns in talks.items():
        turns = [(t[3].decode(), t[5].decode()) for t in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        want.append((str(conv), len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), len(chat.Template().format(turns)[0])))
    got = queries.QUERIES["op2_chat_formatting"](spark, odd if folder == "odd" else folder).collect()
    assert sorted((str(r.conv_id), *tuple(r)[1:6]) for r in got) == sorted(want)


@pytest.mark.parametrize("folder", ["odd", SMALLEST])
def test_secrets_query(spark, odd, folder):  # noqa: F811
    folder = odd if folder == "odd" else folder
    patterns = (
        ("assign", re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    )
    want = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        base = sorted(((m.start(), k, kind, m.end()) for k, (kind, p, good) in enumerate(patterns) for m in p.finditer(r.text or "") if good(m)))
        count = collections.Counter(b[2] for b in base)
        spans = ",".join(f"{kind}:{s}:{e}" for kind, s, e in secrets.secret_spans(r.text or ""))
        want.append((str(r.doc_id), count["assign"], count["access"], count["hex"], sha(",".join(f"{kind}:{s}:{e}" for s, _, kind, e in base)), spans))
    got = queries.QUERIES["op10_secret_scans"](spark, folder).collect()
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in got) == sorted(want)


def test_lm_query(spark, odd):  # noqa: F811
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{odd}/documents.parquet").collect()]
    counts = [collections.Counter() for _ in range(ppm.ORDER + 1)]
    for doc, text in rows:
        if crc(doc, 10):
            s = bytes([ppm.START]) * ppm.ORDER + text.encode() + bytes([ppm.END])
            for k in range(ppm.ORDER, len(s)):
                for n in range(ppm.ORDER + 1):
                    counts[n][s[k - n : k + 1]] += 1
    grams = {n + 1: (np.array([int.from_bytes(g, "big") for g in c], np.uint64), np.array(list(c.values()))) for n, c in enumerate(counts)}
    want = ppm.PpmModel.of(ppm.ORDER, grams).log10(*utf8_view(pa.array([t for _, t in rows])))
    got = queries.QUERIES["op8_lm_scoring"](spark, odd).collect()
    assert sorted((str(r.doc_id), round(r.score, 4)) for r in got) == sorted((str(d), round(w, 4)) for (d, _), w in zip(rows, want.tolist(), strict=True))


def test_svm_finds_the_least_loss():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=60) > 0, 1.0, -1.0)
    loss = lambda w: 0.5 * (w @ w) + 10.0 * np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])) ** 2 @ np.ones(60)
    w = np.zeros(6)
    for _ in range(20_000):
        slack = np.maximum(0, 1 - y * (x @ w[:-1] + w[-1]))
        w -= 2e-4 * (w - 20.0 * np.append((slack * y) @ x, slack @ y))
    assert loss(language.linear_svm(x, y, 10.0, 400).astype(float)) == pytest.approx(loss(w), rel=1e-3)


@pytest.mark.parametrize("folder", ["odd", SMALLEST])
def test_language_query(spark, odd, folder):  # noqa: F811
    folder = odd if folder == "odd" else folder
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    known = {r.lang for r in rows if crc(r.doc_id, 5) and r.lang and r.text and language.has_letter(r.text)}
    got = queries.QUERIES["op4_language_id"](spark, folder).collect()
    assert sorted((str(r.doc_id), r.held_out) for r in got) == sorted((str(r.doc_id), crc(r.doc_id, 5) == 0) for r in rows)
    model = language.fit_languages(docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 0))
    language_, score = model.predict(language.profiles(*utf8_view(pa.array([r.text for r in rows]))))
    want = [(str(r.doc_id), lang if language.has_letter(r.text or "") else "und", round(float(s), 5) if language.has_letter(r.text or "") else 0.0) for r, lang, s in zip(rows, language_, score, strict=True)]
    assert sorted((str(r.doc_id), r.lang_pred, round(r.score, 5)) for r in got) == sorted(want)
    assert {w[1] for w in want} <= {*known, "und"}


def test_letters_are_unicode_letters(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["½ ²", "Ⅷ", "１２", "ª", "ー", "字"])], "doc_id long, text string")
    model = language.fit_languages(spark.createDataFrame([("the and of", "en"), ("le la des", "fr")], "text string, lang string"))
    assert [r.lang_pred == "und" for r in language.predict_languages(docs, model).orderBy("doc_id").collect()] == [True, True, True, False, False, False]
    assert language.fit_languages(docs.select("text", F.lit("xx").alias("lang")).where("doc_id < 3")) is None


def test_samples_of_languages_are_bounded(spark):
    rows = [(f"word{k} der die" if k % 3 else f"word{k} the of", "de" if k % 3 else "en") for k in range(60)]
    model = language.fit_languages(spark.createDataFrame(rows, "text string, lang string"), sample=50, of_all=8)
    assert set(model.within["germanic"].classes) == {"de", "en"}


def test_ftrl_against_a_plain_loop():
    rng = np.random.default_rng(6)
    rows = [np.unique(rng.integers(0, 40, 6)).astype(np.int32) for _ in range(80)]
    y = np.array([float(3 in r or 17 in r) for r in rows])
    model = toxicity.Ftrl(bits=6, l1=0.5)
    used, w, bias = model.fit(rows, y)
    z, n, bz, bn = [0.0] * 64, [0.0] * 64, 0.0, 0.0
    weight = lambda i: 0.0 if abs(z[i]) <= model.l1 else -(z[i] - math.copysign(model.l1, z[i])) / ((model.beta + math.sqrt(n[i])) / model.alpha + model.l2)
    for _ in range(model.passes):
        for row, label in zip(rows, y, strict=True):
            ws, b = {i: weight(i) for i in row.tolist()}, -bz / ((model.beta + math.sqrt(bn)) / model.alpha)
            g = 1 / (1 + math.exp(-(sum(ws.values()) + b + model.start))) - label
            for i, wi in ws.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / model.alpha * wi
                n[i] += g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / model.alpha * b
            bn += g * g
    assert dict(zip(used.tolist(), w.tolist(), strict=True)) == pytest.approx({i: weight(i) for i in range(64) if weight(i)}, rel=1e-5)
    assert bias == pytest.approx(model.start - bz / ((model.beta + math.sqrt(bn)) / model.alpha))


def test_features_by_hand():
    rows = toxicity.feature_rows(*utf8_view(pa.array(["Abcdefghij xy abcdefghij", "abcdefghij", "abcd", ""])))
    # words, beginnings of 4 to 8 bytes, pairs, pairs with one between
    assert [len(r) for r in rows] == [2 + 5 + 2 + 1, 1 + 5, 1, 0] and set(rows[1].tolist()) <= set(rows[0].tolist())


def test_toxicity_of_each_language(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang")
    got = queries.QUERIES["op6_toxicity"](spark, LARGER).where("held_out").join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").join(docs, "doc_id").toPandas()
    toxic = got[got.toxic == 1]
    assert toxic.predicted.mean() >= 0.9 and got[got.toxic == 0].predicted.mean() <= 0.01
    assert (toxic.groupby("lang").predicted.mean() >= 0.7).all()


def test_the_sample_of_labels_is_bounded(spark):
    docs = spark.createDataFrame([(k, f"{'idiot moron' if k % 2 else 'kind words'} t{k}") for k in range(200)], "doc_id long, text string")
    labels = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    for bound in ({"most": 50}, {"most_features": 500}):
        used, w, bias = toxicity.fit_toxicity(docs, labels, **bound)
        assert 0 < len(used) == len(w) and bias < 0


CLASHING = ("_text", "toxicity", "_keep", "n_lines", "n_dropped", "_doc", "_row", "lang_pred", "lang_score", "ppm_log10", "_head", "_rare", "_id", "_worded", "_DOC_", "row", "doc", "keep", "sid", "w", "length", "x", "y", "h")


@pytest.fixture(scope="module")
def clashing(spark, odd):  # noqa: F811
    docs = spark.read.parquet(f"{odd}/documents.parquet").drop("row", "_h")
    return docs.withColumns({c: F.concat(F.lit(f"{c}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHING})


def kept_values(df, but=()):
    names = [c for c in CLASHING if c not in but]
    return all(all(r[c] == f"{c}/{'none' if r.doc_id is None else r.doc_id}" for c in names) for r in df.collect())


def test_stages_keep_columns_of_any_name(spark, odd, clashing):  # noqa: F811
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, odd)
        assert out.columns == clashing.columns and kept_values(out) and out.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, clashing, odd).count() >= clashing.count()


def test_operators_replace_columns_of_their_own_names_only(spark, odd, clashing):  # noqa: F811
    labels, train = spark.read.parquet(f"{odd}/labels.parquet"), clashing.select("text", "lang")
    for got, own in (
        (toxicity.score_toxicity(clashing, toxicity.fit_toxicity(clashing, labels)), ["toxicity"]),
        (line_dedup.drop_repeated_lines(clashing), ["n_lines", "n_dropped"]),
        (language.predict_languages(clashing, language.fit_languages(train)), ["lang_pred", "lang_score"]),
        (ppm.score_texts(clashing, ppm.fit_ppm(train.select("text"))), ["ppm_log10"]),
    ):
        assert got.count() == clashing.count() and set(got.columns) == set(clashing.columns) and kept_values(got, own)
        assert all(not isinstance(r[c], str) or "/" not in r[c] for r in got.collect() for c in own)


def brute_lines(rows):
    holders = collections.defaultdict(set)
    for doc, text in rows:
        for line in text.split("\n"):
            if len(line.strip(line_dedup.BLANK)) >= 40:
                holders[line_dedup.line_key(line)].add(LOW if doc is None else doc)
    drop = lambda doc, x: len(h := holders.get(line_dedup.line_key(x), ())) >= 5 and max(h) != (LOW if doc is None else doc)
    return [(doc, "\n".join(x for x in text.split("\n") if not drop(doc, x))) for doc, text in rows]


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SMALLEST}/benchmark.parquet").collect()]
    rows = lambda df: sorted((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect())
    civil = corpus_pipeline.civil(spark, docs, SMALLEST)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALLEST}/labels.parquet").collect()}
    kept = {doc for doc, _ in rows(civil)}
    assert kept < {r.doc_id for r in docs.collect()} and sum(doc in kept for doc, toxic in labels.items() if not toxic) >= 0.98 * sum(not t for t in labels.values())
    want = sorted(brute_lines(rows(civil)))
    lines = corpus_pipeline.without_repeated_lines(spark, civil, SMALLEST)
    assert rows(lines) == want and {r.n_chars - len(r.text) for r in lines.collect()} == {0}
    groups = brute_groups(want)
    want = sorted((doc, text) for (doc, text), (_, least, _) in zip(want, groups, strict=True) if doc == least)
    distinct = corpus_pipeline.distinct_documents(spark, lines, SMALLEST)
    assert rows(distinct) == want
    want = [(doc, text) for doc, text in want if not brute_windows(text, items)[1]]
    clean = corpus_pipeline.uncontaminated(spark, distinct, SMALLEST)
    assert rows(clean) == want
    tokenizer = packing.Tokenizer(queries.tokenizer_path())
    lengths = {doc: len(tokenizer.slow(text)) // 4 + 1 for doc, text in want}
    packed = corpus_pipeline.run(spark, SMALLEST).toPandas()
    assert packed.groupby("doc_id").length.sum().to_dict() == lengths
    assert packed.sequence_id.nunique() <= math.ceil(sum(lengths.values()) / packing.CAPACITY) * 1.02 + 1
    for _, s in packed.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1].tolist()] and s.length.sum() <= packing.CAPACITY


def test_full_pieces_have_their_own_sequences(spark):
    pieces = spark.createDataFrame([(k, 0, 0, 8, k) for k in range(50)] + [(k, 0, 0, 3, k) for k in range(100, 140)] + [(200, 0, 0, 2, 1)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.best_two_fit(pieces, 8).toPandas()
    full = got[got.length == 8]
    assert len(got) == 91 and full.sequence_id.nunique() == 50 and (full.sequence_id < 0).all() and (got[got.length < 8].sequence_id >= 0).all()
    assert got.groupby("sequence_id").length.sum().max() <= 8 and got[got.length < 8].sequence_id.nunique() == 20


def test_many_of_one_length_are_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "LEAST_RANKED", 7)
    pieces = spark.range(300).selectExpr("id as doc_id", "0 as piece", "0L as start", "case when id % 3 = 0 then 5L else 3L end as length", "id as ids_crc32")
    got = packing.best_two_fit(pieces, 8).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 8 and not got.duplicated(["sequence_id", "offset"]).any() and got.sequence_id.nunique() == 150


def test_merge_order(tmp_path):
    assert packing.merges_by_id(queries.tokenizer_path())
    for merges, fits in (([["a", "b"], ["ab", "c"]], True), ([["ab", "c"], ["a", "b"]], False), ([["a", "b"]], False)):
        (tmp_path / "v.json").write_text(__import__("json").dumps({"model": {"vocab": {"a": 0, "b": 1, "c": 2, "ab": 3, "abc": 4}, "merges": merges}}))
        assert packing.merges_by_id(str(tmp_path / "v.json")) == fits


def test_groups_whose_head_is_no_neighbour(spark, monkeypatch):
    # a chain of texts, each like the next only, and a head that few of its bucket reach
    base = [f"c{k}" for k in range(200)]
    docs = [(k, " ".join(f"n{j}" if j < 6 * k else w for j, w in enumerate(base))) for k in range(20)]
    docs += [(100 + k, " ".join([*(f"m{k}x{j}" for j in range(60)), *base[60:]])) for k in range(8)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "CLUSTER_BLOCK", 3)
    want = sorted(brute_groups(docs))
    assert sorted(map(tuple, jaccard_join.similarity_groups(frame).select("doc_id", "class_id", "n_links").collect())) == want
    uncounted = jaccard_join.similarity_groups(frame, counted=False).select("doc_id", "class_id").collect()
    assert sorted(map(tuple, uncounted)) == [w[:2] for w in want]
    assert len({w[1] for w in want}) > 1 and {r.doc_id for r in jaccard_join.one_of_each_group(frame).collect()} == {w[1] for w in want}


def test_hot_keys_meet_by_broadcast(spark, monkeypatch):
    from plumbline.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 3)
    monkeypatch.setattr(common, "HOT", 2)
    edges = [(0, k) for k in range(1, 60)] + [(k, k + 1) for k in range(100, 120)] + [(200 + k % 5, 300 + k) for k in range(40)]
    got = {r.node: r.root for r in __import__("plumbline.llm.graph", fromlist=["x"]).connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(60), 0), **dict.fromkeys(range(100, 121), 100), **{200 + k: 200 + k for k in range(5)}, **{300 + k: 200 + k % 5 for k in range(40)}}
    assert __import__("plumbline.llm.graph", fromlist=["x"]).connected_components(spark.createDataFrame([(1, 1), (None, 2)], "u long, v long")).count() == 0


def test_contamination_of_clean_and_long_items(spark):
    words = [f"k{j}" for j in range(30)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:9])), (3, " ".join(words[::-1])), (4, "K0, K1; " + " ".join(words[2:10]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words[:12]))], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.clean_documents(docs, items).collect()) == [2, 3]
