import json
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm import chat, mixing, pii, quality


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), len(lines) - len(set(lines)), len(cover)


def test_statistics_equal_brute_force(spark, docs, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = Counter((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.quality_rules(docs, labels).collect())
    want = Counter()
    for r in rows:
        b = brute(r[1] or "")
        want[(*b, b[0] < 50 or 100 * b[4] > 50 * b[0])] += 1
    assert got == want


def test_rules_separate_what_can_be_separated(spark):
    rows, labels = [], []
    for i in range(120):
        junk = i % 4 == 0
        rows.append((i, " ".join(f"w{i}x{k}{'##' if junk and k % 2 else ''}" for k in range(60))))
        labels.append((i, 0 if junk else 1))
    labels += [(None, 1), (5000, None), (3, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert {r["doc_id"] for r in got if not r["kept"]} == {i for i in range(0, 120, 4)}
    assert all((r["rule"] is None) == r["kept"] for r in got)


def test_the_result_can_be_filtered_by_every_column(spark, docs, rows):
    out = quality.quality_rules(docs, spark.createDataFrame([(3, 0), (4, 1)], "doc_id long, quality int"))
    whole = out.collect()
    tests = {c: F.col(c) if t == "boolean" else F.col(c) > 0 if t == "bigint" else F.col(c).isNull() for c, t in out.dtypes}
    for c, test in tests.items():
        want = sum(bool(r[c]) if isinstance(r[c], bool) else r[c] is None if c == "rule" else (r[c] or 0) > 0 for r in whole)
        assert out.filter(test).count() == want, c
    assert out.filter("kept AND n_words > 60 AND NOT base_failed AND n_repeat_words < 9").count() == sum(r["kept"] and r["n_words"] > 60 and r["n_repeat_words"] < 9 for r in whole)


def test_rules_of_empty_tables(spark, empty):
    assert quality.quality_rules(empty, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


# ---------------------------------------------------------------- chat


def test_every_declared_layout(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant", "extra": 1}], "id": 3},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"turns": [{"role": "user", "text": "a"}, {"role": "assistant", "text": "b"}]},
        {"instruction": "a", "output": "b", "input": ""},
        {"prompt": "a", "completion": "b", "meta": {"x": [1]}},
        {"prompt": "a", "response": "b"},
        {"question": "a", "answer": "b"},
        {"unknown": 1},
        {"messages": []},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, None), (91, "not json")], "conv_id long, record string")
    got = defaultdict(list)
    for r in chat.canonical(df).orderBy("conv_id", "turn").collect():
        got[r["conv_id"]].append((r["role"], r["text"]))
    assert got == {i: [("user", "a"), ("assistant", "b")] for i in range(7)}
    assert {r["conv_id"] for r in chat.unmatched(df).collect()} == {7, 8, 90, 91}


def test_fields_of_other_layouts_are_ignored(spark):
    one = [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]
    records = [
        {"prompt": "p", "prompt_id": "x", "messages": one},
        {"system": "s", "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"conv_id": 3, "messages": one, "system": ""},
        {"instruction": "a", "input": "", "output": "b", "text": "whole", "turn": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id long, record string")
    got = defaultdict(list)
    for r in chat.canonical(df, must_match=True).orderBy("conv_id", "turn").collect():
        got[r["conv_id"]].append((r["role"], r["text"]))
    two = [("user", "a"), ("assistant", "b")]
    assert got == {0: two, 1: [("system", "s"), *two], 2: two, 3: two} and not chat.unmatched(df).count()
    with pytest.raises(Exception, match="no declared layout"):
        chat.canonical(df.unionByName(spark.createDataFrame([(9, '{"x": 1}')], df.schema)), must_match=True).collect()


def test_parts_nesting_and_pairs(spark):
    records = [
        {"data": {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"text": "b"}]}, {"role": "bot", "content": "c"}]}},
        {"prompt": "ab", "chosen": "c", "rejected": "d"},
        {"chosen": [{"role": "user", "content": "ab"}, {"role": "assistant", "content": "c"}], "rejected": [{"role": "user", "content": "x"}], "prompt": "ab"},
        {"messages": [{"role": "user", "content": ["a", {"text": "b"}]}, {"role": "model", "content": "c", "name": None}], "odd `name`": {"x: y": [[1]]}},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id long, record string")
    got = defaultdict(list)
    for r in chat.canonical(df).orderBy("conv_id", "turn").collect():
        got[r["conv_id"]].append((r["role"], r["text"]))
    assert got == {i: [("user", "ab"), ("assistant", "c")] for i in range(4)}


def test_all_nested_paths_are_collected(spark):
    record = '{"a": [{"b": 1, "c": {"d": null}}, {"e": [[2]]}], "f": {"g": "x"}, "h": []}'
    got = spark.range(1).select(chat.paths_of(F.try_parse_json(F.lit(record)))).first()[0]
    assert set(got) == {"a", "a[]", "a[].b", "a[].c", "a[].c.d", "a[].e", "a[].e[]", "a[].e[][]", "f", "f.g", "h", "h[]"}


TRICKY = st.text(st.sampled_from("<|im_endstart>\\\n a/n"), max_size=25)


def test_template_is_reversible(spark):
    cases = []

    @settings(max_examples=200, deadline=None, database=None)
    @given(TRICKY, TRICKY)
    def gather(role, text):
        cases.append((len(cases), 0, role, text))

    gather()
    cases += [(-7, 0, "assistant", None), (-7, 1, None, "x"), (-7, 1, None, "x"), (None, 5, "assistant", "<|im_end|>\n<|im_start|>user\n")]
    df = spark.createDataFrame(cases, "conv_id long, turn long, role string, text string")
    out = chat.format_turns(chat.turns_of_table(df.withColumn("formatted", F.lit(1))))
    for r in out.withColumn("read", chat.parse(F.col("formatted"))).collect():
        want = sorted((t, ro or "", te or "") for c, t, ro, te in cases if c == r["conv_id"])
        assert [(x["role"], x["text"]) for x in r["read"]] == [(ro, te) for _, ro, te in want]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
    assert chat.chat_digests(out).count() == out.count()


def test_chat_of_an_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_digests(chat.format_turns(chat.turns_of_table(df))).count() == 0


# ---------------------------------------------------------------- mixing


def test_period_meets_every_window():
    for weights in ({"a": 5, "b": 3, "c": 1, "d": 0.2}, {"x": 1.0}, {str(i): i + 1 for i in range(30)}):
        share = mixing.quotas(weights, 400)
        rows = mixing.period(share)
        slots = sum(share.values())
        assert sorted(r[4] for r in rows) == list(range(slots))
        done = Counter()
        for k, _, release, deadline, slot in rows:
            assert release <= slot < deadline
        for k, _, _, _, slot in sorted(rows, key=lambda r: r[4]):
            done[k] += 1
            assert all(abs(done[s] - (slot + 1) * q / slots) < 1 for s, q in share.items())


def test_mix_places_every_row_once(docs, rows):
    got = mixing.mix(docs, block_rows=4, shard_rows=5).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    places = defaultdict(set)
    for r in got:
        assert r["release"] <= r["slot"] < r["deadline"]
        places[r["source"] or ""].add((r["block"], r["place"]))
    sizes = Counter(r[2] or "" for r in rows)
    for s, n in sizes.items():
        assert places[s] == {(i // 4, i % 4) for i in range(n)}
    ordered = mixing.in_order(docs, block_rows=4)
    assert ordered.columns == docs.columns and ordered.count() == len(rows)


def test_no_source_is_a_block_off_its_exact_weight():
    """Over many periods, against the weights themselves and a plain simulation of earliest deadline first."""
    from fractions import Fraction

    for weights in ({"a": 1, "b": 1, "c": 1}, {"a": 0.5, "b": 0.3, "c": 0.1999, "d": 0.0001}, {"x": 7, "y": 2.5, "z": 0}):
        share = mixing.shares(weights)
        own = {k: q for k, q in share.items() if q}
        total, sum_ = sum(own.values()), sum(Fraction(str(w)) for w in weights.values())
        assert all(Fraction(q, total) == Fraction(str(weights[k])) / sum_ for k, q in share.items())
        slots = {r[4]: r[0] for r in mixing.period(own)}
        done, given = Counter(), Counter()
        for t in range(3 * total if total > 1000 else 1000):
            eligible = [(-(-(given[k] + 1) * total // q), k) for k, q in own.items() if given[k] * total // q <= t]
            k = min(eligible)[1]
            given[k] += 1
            done[slots[t % total]] += 1
            assert slots[t % total] == k
            assert all(abs(done[s] - (t + 1) * Fraction(q, total)) < 1 for s, q in own.items())


def test_sources_without_a_weight_come_last(spark):
    rows = [(i, f"s{i % 3}") for i in range(60)] + [(100, None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights={"s0": 0.7, "s1": 0.3, "s2": 0}, block_rows=4).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    last = max(r["slot"] for r in got if r["source"] in ("s0", "s1"))
    tail = [r for r in got if r["source"] not in ("s0", "s1")]
    assert len(tail) == 21 and all(r["slot"] > last and r["release"] is None and r["weight"] == 0 for r in tail)
    assert len({(r["slot"], r["place"]) for r in got}) == len(got)


def test_mix_of_an_empty_table(empty):
    assert mixing.mix(empty).count() == 0


# ---------------------------------------------------------------- pseudonyms

PRIVATE = [
    ("mail ana.b@mail7.example.com!", "email"), ("card 4532015112830366 x", "card"), ("4532-0151-1283-0366", "card"), ("(017) 555-7713", "phone"), ("+1 212-555-0123", "phone"),
    ("ip 233.254.104.120.", "ip"), ("ssn 123-45-6789", "ssn"), ("on 2024-02-29 and", "date"), ("31.12.1999", "date"), ("02/29/2024", "date"),
    ('token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"', "secret"),
]
MORE = [
    ("25/12/1990", "date"), ("+44 20 7946 0958", "phone"), ("call 5551234567.", "phone"), ("at 2001:db8:0:1::8a2e:7334 now", "ipv6"), ("FE80:0:0:0:202:B3FF:FE1E:8329", "ipv6"),
    ("Jan 5, 1990", "date"), ("on 17 September 2003 he", "date"), ("+442079460958", "phone"),
]
PLAIN = ["31 February 1990", "std::vector", "12:34:56", "1234567890", "1700000000000", "a::b and fe80", "card 4532015112830367", "999.254.104.120", "666-45-6789", "000-12-3456", "2023-02-29", "13/45/2024", "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda", "12 words, 345 and 1999", "a@b", "0000000000000000", ""]


def test_what_is_replaced_and_what_stays(spark):
    rows = [(i, t, "x") for i, (t, _) in enumerate(PRIVATE)] + [(100 + i, t, "y") for i, t in enumerate(PLAIN)] + [(500, None, "z")]
    got = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string, kinds string"), "key").collect()}
    for i, (t, kind) in enumerate(PRIVATE):
        assert got[i]["n_replaced"] == 1 and got[i][f"n_{kind}"] == 1 and got[i]["text"] != t, t
        if kind in ("card", "phone", "ip", "ssn", "date"):
            shape = lambda s: re.sub(r"\d", "9", s)
            assert kind == "ip" or shape(got[i]["text"]) == shape(t)
    for i, t in enumerate(PLAIN):
        assert (got[100 + i]["text"], got[100 + i]["n_replaced"]) == (t, 0)
    assert got[500]["text"] == ""
    again = pii.pseudonymise(spark.createDataFrame([(i, got[i]["text"]) for i in range(len(PRIVATE)) if PRIVATE[i][1] not in ("email", "secret")], "doc_id long, text string"), "key").collect()
    assert all(r["n_replaced"] == 1 for r in again)  # pseudonyms are valid themselves
    assert got[1]["text"].split()[1] == got[2]["text"].replace("-", "")  # one number, two formats


def test_more_formats_are_replaced_in_their_format(spark):
    rows = [(i, t) for i, (t, _) in enumerate(MORE)] + [(50 + i, f"{t} and {t}") for i, (t, _) in enumerate(MORE)] + [(99, "w " * 30_000 + "5551234567")] * 2
    got = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()
    by = {r["doc_id"]: r for r in got}
    for i, (t, kind) in enumerate(MORE):
        assert by[i]["n_replaced"] == by[i][f"n_{kind}"] == 1 and by[i]["text"] != t, t
        assert by[50 + i]["text"] == f"{by[i]['text']} and {by[i]['text']}"
        if kind == "phone":
            assert re.sub(r"\d", "9", by[i]["text"]) == re.sub(r"\d", "9", t)
        if kind == "ipv6":
            assert re.sub("[0-9a-fA-F]", "0", by[i]["text"].replace("at", "").replace("now", "")) == re.sub("[0-9a-fA-F]", "0", t.replace("at", "").replace("now", ""))
    assert by[1]["text"].startswith("+44 ") and by[5]["text"].count(",") == 1
    assert [r["text"] for r in got if r["doc_id"] == 99] == ["w " * 30_000 + by[2]["text"][5:-1]] * 2


def test_pseudonyms_equal_a_plain_feistel(spark):
    import hashlib
    import hmac

    def prf(key, tweak, turn, half):
        return int(hmac.new(key.encode(), f"{tweak}|{turn}|{half}".encode(), hashlib.sha256).hexdigest()[:15], 16)

    def permuted(digits, key, tweak):
        u = len(digits) // 2
        a, b, m, n = int(digits[:u]), int(digits[u:]), 10**u, 10 ** (len(digits) - u)
        for turn in range(1, pii.ROUNDS + 1):
            a, b, m, n = b, (a + prf(key, f"{tweak}:{len(digits)}", turn, b)) % m, n, m
        return f"{a:0{u}d}{b:0{len(digits) - u}d}"

    def luhn(body):
        return next(c for c in "0123456789" if sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(body + c))) % 10 == 0)

    for key in ("short-key-5513", "a key of more than sixty-four bytes, which is hashed before it is padded to a block"):
        df = spark.createDataFrame([(1, "4532015112830366 or (212) 555-0123")], "doc_id long, text string")
        body = permuted("453201511283036", key, "card")
        phone = permuted("2125550123", key, "phone")
        out = pii.pseudonymise(df, key)
        assert out.first()["text"] == f"{body}{luhn(body)} or ({phone[:3]}) {phone[3:6]}-{phone[6:]}"
        plan = out._jdf.queryExecution().toString() + out._jdf.queryExecution().optimizedPlan().toString()
        assert key not in plan and pii.pads(key)[0].hex() not in plan.lower()


def test_feistel_is_a_bijection(spark):
    df = spark.range(189 * 11).withColumnRenamed("id", "v")
    a, b = pii.feistel(F.floor(F.col("v") / 11), F.pmod("v", F.lit(11)), F.lit(189), F.lit(11), "k", F.lit("t"))
    got = df.select(a.alias("a"), b.alias("b")).distinct()
    assert got.count() == 189 * 11 and got.filter("a < 0 OR a >= 189 OR b < 0 OR b >= 11").count() == 0
    numbers = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert numbers.select(pii.digits_permuted(F.col("d"), "k", F.lit("t")).alias("p")).distinct().filter("length(p) = 3").count() == 1000


def test_dates_are_a_bijection(spark):
    days = spark.range(0, 146_097, 7).select(F.date_format(F.date_add(F.to_date(F.lit("1800-01-01")), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    out = days.select(pii._date(F.col("d"), "k").alias("p"))
    assert out.distinct().count() == days.count() and out.filter("p < '1800-01-01' OR p > '2199-12-31'").count() == 0


def test_pseudonyms_of_an_empty_table(empty):
    assert pii.pseudonymise(empty, "k").count() == 0
