"""Scalar, array, payload and metric functions against literal cases."""

from __future__ import annotations

import json
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import arrays, metrics, payloads, text, vectors


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_clean_text(spark):
    assert one(spark, text.clean_text("t"), t=" a  b\n\tc ") == "a b c"
    assert one(spark, text.clean_text("t"), t=None) == ""
    assert one(spark, text.normalize_text("t"), t="Hola; Mundo.") == "hola mundo"


def test_fold_and_tokens(spark):
    assert one(spark, text.fold("t"), t="Úlcera TIÑA acné") == "ulcera tina acne"
    assert one(spark, text.folded_tokens("t", 2), t="El acné, sí y no") == ["el", "acne", "si", "no"]


@pytest.mark.parametrize("n,bucket", [(0, "short_0_20"), (20, "short_0_20"), (21, "medium_21_60"), (60, "medium_21_60"), (61, "long_61_plus")])
def test_length_bucket(spark, n, bucket):
    assert one(spark, text.length_bucket(F.lit(n)), t="") == bucket


def test_truncate_and_counts(spark):
    assert one(spark, text.truncate("t", 4), t="abcdef") == "abc…"
    assert one(spark, text.word_count("t"), t="") == 0
    assert one(spark, text.image_count("t"), t="['a', 'b']") == 2
    assert one(spark, text.image_count("t"), t="a;b;;c") == 3
    assert one(spark, text.question_text("a", "b", "\n"), a=" x ", b="") == "x"


def test_numbers(spark):
    assert one(spark, text.three_decimals(F.col("t")), t="0.12345") == "0.123"
    assert one(spark, text.three_decimals(F.col("t")), t="nan") == ""
    assert one(spark, text.safe_number("t"), t="x") is None
    assert one(spark, text.method_token("t"), t="a/b-c.d") == "a_b_c_d"


def test_labels(spark):
    assert one(spark, text.method_label("t"), t="retrieval_tfidf") == "TF-IDF"
    assert one(spark, text.split_label("t"), t="valid_ht") == "valid"
    assert one(spark, text.dataset_variant("t", F.lit("a\\dataset_enriched\\b")), t="") == "dataset_enriched"
    assert one(spark, text.is_generic("t"), t="Por favor CONSULTE a un dermatólogo ya")


def test_source_hash_is_that_of_spaced_json(spark):
    import hashlib
    import json

    want = hashlib.sha256(json.dumps({"a": 'x"y', "b": "ñ"}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    assert one(spark, text.source_hash({"b": "b", "a": "a"}), a='x"y', b="ñ") == want


def test_answers(spark):
    assert one(spark, arrays.longest_answer("a"), a=["aa", "bb", "c"]) == "aa"
    assert one(spark, arrays.dedupe_answers("a"), a=["A b", "a  B", "", "c"]) == ["A b", "c"]
    assert one(spark, arrays.valid_answers("a"), a=["x", " ", "y"]) == ["x", "y"]


F1_CASES = [("la la la", "la la", 0.8, 0.4, 0.8, 0.8), ("acné", "acne", 0, 0, 1, 0), ("", "", 0, 0, 1, 1), ("algo", "", 0, 0, 0, 0), ("psoriasis", "onicomicosis foliculitis", 0, 0, 0, 0)]


@pytest.mark.parametrize("p,r,a,b,c,d", F1_CASES)
def test_token_f1(spark, p, r, a, b, c, d):
    got = [one(spark, metrics.token_f1("p", "r", v), p=p, r=r) for v in ("multiset", "set", "service", "notebook")]
    assert got == pytest.approx([a, b, c, d])


def test_overlap_and_lcs_forms_agree(spark):
    rng = random.Random(3)
    rows = [([rng.choice("abcd") for _ in range(rng.randint(0, 9))], [rng.choice("abcd") for _ in range(rng.randint(0, 9))]) for _ in range(40)]

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    got = df.select("a", "b", metrics.overlap(a, b).alias("o"), metrics.lcs_length(a, b).alias("l")).collect()
    for r in got:
        assert r.o == sum((Counter(r.a) & Counter(r.b)).values())
        assert r.l == lcs(r.a, r.b)
    assert df.select(metrics.overlap(a, F.lit(None).cast("array<string>")).alias("o")).filter("o <> 0").count() == 0


def test_ngrams_of_batches_against_counters(spark, monkeypatch):
    """Odd texts (marks, planes beyond the first, white space of Unicode, nulls) in blocks of a few pairs."""
    rng = random.Random(5)
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choice("ab cd\u00a0é\u3000😀\x1c1.,'") for _ in range(rng.choice([0, 1, 5, 40, 400])))
    rows = [(k, text(), text()) for k in range(150)] + [(200, "la " * 900, "la la"), (201, "x", None)]
    gram = lambda t, n: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    df = spark.createDataFrame(rows, "k int, p string, r string").coalesce(1)
    for pairs, symbols in ((1 << 12, 1 << 20), (7, 100)):
        monkeypatch.setattr(metrics, "BATCH_PAIRS", pairs)
        monkeypatch.setattr(metrics, "BATCH_SYMBOLS", symbols)
        p, r = ([x[i] for x in rows] for i in (1, 2))
        got = metrics.chrf_stats.func(pa.array(p, pa.string()), pa.array(r, pa.string())).to_pylist()
        for x, y, s in zip(p, r, got):
            a, b = ["".join((t or "").split()) for t in (x, y)]
            assert s == [v for n in range(1, 7) for v in (sum(gram(a, n).values()), sum(gram(b, n).values()), sum((gram(a, n) & gram(b, n)).values()))]
    for q in df.select("p", "r", metrics.chrf_stats("p", "r").alias("c"), metrics.tokens_13a("p").alias("a"), metrics.tokens_13a("r").alias("b"), metrics.bleu_stats("p", "r").alias("s")).collect():
        assert q.s == [len(q.a), len(q.b), *(v for n in range(1, 5) for v in (sum((gram(q.a, n) & gram(q.b, n)).values()), sum(gram(q.a, n).values())))]
        assert q.c[0] == len("".join((q.p or "").split()))


def test_rouge_chrf_bleu(spark):
    assert one(spark, metrics.rouge_l("p", "r"), p="a b c d", r="a c b d") == pytest.approx(0.75)
    for p, r, want in [("abc", "abc", 100), ("abcd", "abce", 47.916667), ("la crema", "la crema nueva", 51.132492), ("xyz", "abc", 0)]:
        assert one(spark, metrics.chrf_score(metrics.chrf_stats("p", "r")), p=p, r=r) == pytest.approx(want, abs=1e-4)
    assert one(spark, metrics.bleu_score(metrics.bleu_stats("p", "r")), p="the cat sat on the mat", r="the cat sat on the mat") == pytest.approx(100)
    assert one(spark, metrics.bleu_score(metrics.bleu_stats("p", "r")), p="", r="x") == 0


def test_payloads(spark):
    for raw in ('{"k": 1}', '```json\n{"k": 1}\n```', 'so: {"k": 1} ok'):
        assert one(spark, F.get_json_object(payloads.repair_json("t"), "$.k"), t=raw) == "1"
    assert one(spark, payloads.repair_json("t"), t="{broken") is None
    good = '{"output": {"synthesized_answer_es": "una dos tres cuatro cinco", "has_conflict": false, "source_support_level": "x"}}'
    assert one(spark, payloads.synthesis("t")["source_support_level"], t=good) == "medium"
    assert one(spark, payloads.synthesis("t"), t='{"synthesized_answer_es": "corta", "has_conflict": false, "source_support_level": "low"}') is None
    assert one(spark, F.size(payloads.contexts("t")), t="oops") == 0
    assert [one(spark, payloads.mock_synthesis("a")["source_support_level"], a=["x"] * n) for n in (0, 1, 4, 5)] == ["low", "low", "medium", "high"]


def test_payloads_are_parsed_once(spark):
    """However many fields are read, each form of a payload is named once in the plan."""
    df = spark.createDataFrame([('{"final": {"synthesized_answer_es": "uno dos tres cuatro cinco", "has_conflict": false, "source_support_level": "high"}}',), ('x {"answer": "a", "evidence": [" b ", ""], "explanation": "c"} y',), ("{oops",), ("",), (None,)], "t string")
    s, e = payloads.synthesis("t"), payloads.explanation_payload("t")
    for c, most in ((s, 2), (e, 2)):
        plan = df.select(c.alias("c"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("from_json") <= most and plan.count("try_parse_json") <= 6
    rows = df.select(s["source_support_level"].alias("l"), e.alias("e")).collect()
    assert [r.l for r in rows] == ["high", None, None, None, None]
    assert [(r.e.answer, r.e.evidence, r.e.explanation, r.e.parse_error) for r in rows] == [("", [], "", False), ("a", ["b"], "c", False), ("", [], "", True), ("", [], "", True), ("", [], "", True)]


def test_both_forms_of_the_synthesis_rules_agree(spark):
    five = "una dos tres cuatro cinco"
    good = {"synthesized_answer_es": five, "has_conflict": False, "source_support_level": "low"}
    less = lambda **x: {k: v for k, v in (good | x).items() if v is not ...}
    raw = [json.dumps(x) for x in (good, less(has_conflict=...), less(has_conflict=None), less(has_conflict="no"), less(source_support_level=None), less(source_support_level=3), less(synthesized_answer_es="corta"), less(synthesized_answer_es=None), less(synthesized_answer_es=f"\u00a0{five}\u2003"), {"final": good}, {"output": json.dumps(good)}, {"result": good, "final": "x"}, {"final": {}, "output": good}, {"output": less(source_support_level=...), "source_support_level": "high"}, [good], {})]
    raw += [f"```json\n{raw[0]}\n```", f"\n\t {raw[0]} \u00a0", f"Respuesta: {raw[0]} fin", f"```{raw[0]}```", "", "{", "null", "{broken", raw[0] + raw[0], "texto sin objeto", "```json\n[1]\n```"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(raw)] + [(99, None)], "k int, t string")
    for r in df.select("k", "t", payloads.synthesis("t").alias("s")).collect():
        assert (r.s is not None) == payloads.valid_synthesis(r.t), r.t
        if r.s is not None:
            assert r.s.synthesized_answer_es == five and r.s.source_support_level in ("low", "medium", "high")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "v array<float>, z array<float>")
    r = df.select(vectors.norm("v").alias("n"), vectors.l2_normalize("v").alias("u"), vectors.l2_normalize("z").alias("z"), vectors.dot("v", "v").alias("d")).first()
    assert r.n == 5 and r.u == pytest.approx([0.6, 0.8]) and r.z == [0, 0] and r.d == 25
