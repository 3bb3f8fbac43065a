from pathlib import Path

import pytest

pytest.importorskip("sentencepiece")

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


def test_stages_keep_what_they_should(spark):
    import corpus_pipeline as p
    from tidewater.llm import bagminhash, exact_dedup, mixing, quality
    from tidewater.llm.common import documents, materialise

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = documents(spark, SF)
    columns, ids = docs.columns, lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    assert [name for name, _ in p.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    made = []
    for name, stage in p.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, SF), name)
        made.append((before, docs))
    (a, b), (c, d), (e, f), (g, h), (i, j) = made
    assert all(x.columns == columns for x in (b, d, f, h))
    assert ids(b) == sorted(r["doc_id"] for r in quality.quality_rules(a, labels).filter("kept").collect())
    assert ids(d) == sorted(r["doc_id"] for r in exact_dedup.exact_dedup(c).filter("kept").collect())
    assert ids(f) == sorted(r["doc_id"] for r in bagminhash.near_duplicates(e).filter("kept").collect())
    assert ids(h) == ids(g) == ids(j)
    slots = {r["doc_id"]: (r["slot"], r["place"]) for r in mixing.mix(g).collect()}
    order = [slots[r["doc_id"]] for r in h.coalesce(1).toLocalIterator()] if h.rdd.getNumPartitions() == 1 else None
    assert order is None or order == sorted(order)
    assert p.run(spark, SF).count() == j.count()


def test_queries_have_the_contract_columns(spark):
    from tidewater.llm.queries import QUERIES

    want = {
        "op1_": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op2_": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        "op3_": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
        "op4_": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op8_": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        "op10_": ["doc_id", "start", "n_tokens", "ids_crc32"],
    }
    for prefix, columns in want.items():
        (name,) = [q for q in QUERIES if q.startswith(prefix)]
        out = QUERIES[name](spark, SF)
        assert out.columns[: len(columns)] == columns


def test_stages_equal_brute_force(spark, tmp_path):
    """Texts are compared, joined and encoded here in plain Python, without the operators."""
    import hashlib
    import re
    import shutil
    import struct
    from collections import Counter, defaultdict

    import sentencepiece as spm

    import corpus_pipeline as p
    from tidewater.llm import bagminhash
    from tidewater.llm.common import documents, materialise
    from tidewater.llm.queries import tokenizer_path

    # the small table, with copies that differ in blanks, and near copies with one word changed
    docs = documents(spark, SF)
    first = [r.asDict() for r in docs.filter("length(text) > 600").orderBy("doc_id").limit(40).collect()]
    more = [{**r, "doc_id": 10**6 + i, "text": r["text"].replace(" ", "  ") if i % 2 else r["text"]} for i, r in enumerate(first[:20])]
    more += [{**r, "doc_id": 2 * 10**6 + i, "text": " ".join(["changed", *r["text"].split(" ")[1:]])} for i, r in enumerate(first)]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    (shutil.copytree if Path(f"{SF}/labels.parquet").is_dir() else shutil.copy)(f"{SF}/labels.parquet", f"{tmp_path}/labels.parquet")

    stages, made, now = dict(p.STAGES), {}, documents(spark, str(tmp_path))
    for name, _ in p.STAGES:
        now = materialise(stages[name](spark, now, str(tmp_path)), name)
        made[name] = now
    rows = {name: [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()] for name, df in made.items() if name != "sentencepiece"}
    ids = lambda name: sorted(r[0] for r in rows[name])

    groups = defaultdict(list)
    for d, text in rows["quality_rules"]:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text)].append((-len(text), d))
    assert any(len(g) > 1 for g in groups.values())
    assert ids("exact_dedup") == sorted(min(g)[1] for g in groups.values())

    def bag(text):  # runs of SHINGLE words, counted
        words = text.encode().lower().split()
        return Counter(tuple(words[i : i + bagminhash.SHINGLE]) for i in range(max(1, len(words) - bagminhash.SHINGLE + 1)))

    bags = [(d, bag(t)) for d, t in rows["exact_dedup"]]
    parent = {d: d for d, _ in bags}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, (a, x) in enumerate(bags):
        for b, y in bags[:i]:
            n = sum((x & y).values())
            if n >= 0.8 * (x.total() + y.total() - n):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert any(parent[d] != d for d in parent)
    assert ids("near_dedup") == sorted(d for d in parent if root(d) == d)

    assert sorted(rows["mixing"]) == sorted(rows["near_dedup"])
    sp, want = spm.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model")), []
    for d, text in rows["mixing"]:
        out = sp.encode(text, add_bos=True, add_eos=True)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((d, len(out), sha(struct.pack(f"<{len(out)}I", *out)), sha(sp.decode(out).encode())))
    got = [tuple(r) for r in made["sentencepiece"].select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got) == sorted(want)
    whole = p.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(tuple(r) for r in whole) == sorted(want)


def test_stages_take_nulls_repeats_clashing_names_and_empty_tables(spark, docs, empty, tmp_path, monkeypatch):
    import corpus_pipeline as p
    from tidewater.llm import mixing

    spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = docs.withColumnsRenamed({"kept": "_d", "_in": "_h"}).selectExpr("*", "1 AS slot", "2 AS text_hash", "3 AS _nth")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns, name
        ids = [r["doc_id"] for r in out.collect()]
        if name != "mixing":
            assert len(ids) == len(set(ids)), name  # of the repeated rows one
        assert stage(spark, empty, str(tmp_path)).count() == 0
    last = p.encoded(spark, odd, str(tmp_path))
    assert last.count() == odd.count() and p.encoded(spark, empty, str(tmp_path)).count() == 0
    at = lambda rows: sorted((str(r["doc_id"]), r["slot"], r["place"]) for r in rows)
    assert at(last.collect()) == at(mixing.mix(odd).collect())
