"""Operators against small literal cases and invariants."""

from __future__ import annotations

import json
import math
import os
import time

import pytest
from pyspark.sql import functions as F

from quillspark.operators import corpus, generation, retrieval, reviewlog, rollup, safety, selection
from quillspark.sources import readers, writers


def test_majority(spark):
    rows = spark.createDataFrame([(1, 0, "X."), (1, 1, "x"), (1, 2, "y")], "c int, p int, a string")
    r = corpus.majority_answer(rows, "c", "p", "a").first()
    assert r.majority_answer == "X." and r.agreement == pytest.approx(2 / 3)


def test_checks(spark):
    rows = spark.createDataFrame([(1, "train"), (1, "test"), (2, "train")], "k int, split string")
    assert [r.k for r in corpus.leakage(rows, "k").collect()] == [1]
    with pytest.raises(ValueError):
        corpus.assert_unique(rows, ["k"])
    with pytest.raises(ValueError):
        corpus.require_split(rows, "valid")
    with pytest.raises(ValueError):
        corpus.require_columns(rows, ["z"])


def test_idf_and_fallback(spark):
    docs = spark.createDataFrame([(1, "acne leve"), (2, "psoriasis")], "doc int, t string")
    counted = retrieval.terms(docs, "doc", "t", bigrams=False)
    table = {r.term: r.idf for r in retrieval.idf(counted, docs.agg(F.count(F.lit(1)).alias("n")), None).collect()}
    assert table["acne"] == pytest.approx(math.log(3 / 2) + 1)
    queries = spark.createDataFrame([(10, "ACNÉ"), (11, "zzz")], "q int, t string")
    best = retrieval.tfidf_search(queries, docs, "q", "doc", "t", 1, bigrams=False, max_df=None)
    got = {r.q: (r.doc, r.score) for r in retrieval.with_fallback(best, queries, docs, "q", "doc").collect()}
    assert got[10][0] == 1 and got[11] == (1, 0.0)


def test_dense_search_excludes_itself_and_breaks_ties_by_id(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "doc long, v array<float>")
    q = v.withColumnRenamed("doc", "q")
    got = {(r.q, r.rank): r.doc for r in retrieval.dense_search(q, v, "q", "doc", "v", 2, exclude_same=True).collect()}
    assert got == {(1, 1): 2, (1, 2): 3, (2, 1): 1, (2, 2): 3, (3, 1): 1, (3, 2): 2}


def test_fusion(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 0.0), (1, 2, 0.0, 1.0)], "q int, d int, t double, v double")
    got = {r.d: r.score for r in retrieval.fuse(df, "t", "v", ["q"], 0.6).collect()}
    assert got == pytest.approx({1: 0.6, 2: 0.4})
    flat = spark.createDataFrame([(1, 5.0), (1, 5.0)], "q int, t double")
    assert [r.x for r in retrieval.min_max(flat, "t", "x", ["q"]).collect()] == [0, 0]
    masked = spark.createDataFrame([(1, 1, 0.0, 1.0, True), (1, 2, 0.0, 0.5, True), (1, 3, 0.0, 0.9, False)], "q int, d int, t double, v double, h boolean")
    got = {r.d: r.score for r in retrieval.fuse(masked, "t", "v", ["q"], 0.6, doc_has_image=F.col("h")).collect()}
    assert got == pytest.approx({1: 0.4, 2: 0.0, 3: 0.0})


def test_k_bounds():
    assert retrieval.bounded_k(None) == 5 and retrieval.bounded_k(500) == 50
    with pytest.raises(ValueError):
        retrieval.bounded_k(0)


def test_rollups(spark):
    x = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "v double")
    r = rollup.five_numbers(x.withColumn("g", F.lit(1)), ["g"], "v").first()
    assert (r.minimum, r.q1, r.median, r.q3, r.maximum) == (1, 1.75, 3, 5.25, 9)
    labels = spark.createDataFrame([("a",), ("",), ("a",), (None,)], "f string")
    assert [(r.label, r["count"], r.rate) for r in rollup.label_rates(labels, ["f"]).collect()] == [("a", 2, 0.5)]
    m = spark.createDataFrame([(1.0, None), (3.0, 5.0)], "a double, b double")
    assert [r.x for r in m.select(rollup.row_mean(["a", "b"]).alias("x")).collect()] == [1.0, 4.0]


def test_one_to_one_join_is_checked(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.6)], "k int, chrf double")
    with pytest.raises(Exception, match="isn't unique"):
        rollup.wide_methods({"a": df, "b": df}, ["k"], ["chrf"]).collect()


def test_selection(spark):
    rows = spark.createDataFrame([(1, 1, 0.0), (1, 2, 1.0), (1, 3, 0.4)], "e int, i int, v double")
    assert selection.representative(rows, "e", "v", "i").first().i == 3
    cases = spark.createDataFrame([(k, float(k)) for k in range(40)], "k int, v double")
    got = {r.k: r.case_bucket for r in selection.review_sample(cases, "v", "k", [39, 5]).collect()}
    assert len(got) == 20 and got[39] == "survey_named_case" and got[0] == "low_metric_case" and got[38] == "high_metric_case" and got[20] == "middle_metric_case"


def verdict(spark, draft, evidence=(), query="", sim=None):
    df = spark.createDataFrame([(draft, list(evidence), query, sim)], "d string, e array<string>, q string, s double")
    return safety.analyze(df, "d", "e", "q", "s").first().verdict


LONG = "El cuadro que describe es compatible con una irritación leve que suele mejorar sola en pocos días."


def test_safety(spark):
    assert verdict(spark, "   ").flags == ["vacio"] and verdict(spark, "").nivel == "alto"
    s = "esta oracion se repite. "
    assert "repetitivo" not in verdict(spark, s * 2).flags and "repetitivo" in verdict(spark, s * 3).flags
    assert verdict(spark, "La cortina del baño está sucia").diagnosticos_no_sustentados == []
    assert verdict(spark, "Tiene TIÑA en el pie").diagnosticos_no_sustentados == ["tina"]
    assert verdict(spark, LONG, query="Úlcera que no cierra hace 4 meses en el pie").banderas_rojas == ["lesion_no_cicatriza"]
    assert verdict(spark, LONG, query="lunar asimétrica").banderas_rojas == []
    weak = verdict(spark, LONG, sim=0.20)
    assert weak.evidencia_debil and weak.nivel == "medio"
    calm = verdict(spark, LONG)
    assert calm.nivel == "bajo" and not calm.evidencia_debil and calm.similitud_max is None
    assert verdict(spark, "Es psoriasis " + LONG, ["caso de linfangioma"]).cambio_de_entidad
    bad = verdict(spark, "Se puede descartar. " + LONG, query="sospecho melanoma")
    assert bad.falsa_tranquilizacion and bad.nivel == "alto"
    for odd in ("😀" * 50, "x" * 5000, "12345"):
        assert verdict(spark, odd).nivel in ("alto", "medio", "bajo")


def test_review_log(spark, tmp_path):
    entries = spark.createDataFrame([("1", "2024", "a", "aprobar", "x", "bajo"), ("2", "2025", "b", "editar", "x y", "alto"), ("3", "2026", "c", "rechazar", None, "alto"), ("4", "2027", "a", "aprobar", "z", None)], "id string, timestamp string, job_id string, accion string, borrador_original string, seguridad_nivel string")
    entries = entries.withColumn("texto_final", F.lit("x")).withColumn("revisor", F.lit(None).cast("string")).withColumn("consulta", F.lit("q"))
    first = reviewlog.first_reviews(reviewlog.resolved(entries))
    s = reviewlog.audit_summary(first).first()
    assert (s.total, s.aprobar, s.editar, s.rechazar, s.tasa_aprobacion) == (3, 1, 1, 1, 0.6667)
    assert s.edicion_media == pytest.approx(1 - s.similitud)
    assert {r.seguridad_nivel: r.n for r in reviewlog.counts(first, "seguridad_nivel").collect()} == {"bajo": 1, "alto": 2}
    assert reviewlog.audit_summary(first.limit(0)).first().tasa_aprobacion is None
    assert reviewlog.approved_cases(first).count() == 2
    p = tmp_path / "log.jsonl"
    p.write_text('{"id": "1"}\n\nnot json\n{"id": "2"}\n')
    assert [r.id for r in readers.read_log(spark, str(p), "id string").collect()] == ["1", "2"]


def test_sources_and_sinks(spark, tmp_path):
    rows = [{"encounter_id": "e1", "image_ids": ["i1"], "responses": [{"content_es": "a", "content_en": "b", "author_id": "x"}]}]
    (tmp_path / "train.json").write_text(json.dumps(rows))
    (tmp_path / "valid_ht.json").write_text(json.dumps(rows))
    df = readers.load_splits(spark, str(tmp_path), ["train", "valid_ht", "missing"])
    assert sorted(r.split for r in df.collect()) == ["train", "valid"]
    with pytest.raises(FileNotFoundError):
        readers.load_splits(spark, str(tmp_path), ["missing"], strict=True)
    (tmp_path / "x.csv").write_text('﻿a,b\n1,"two\nlines"\n')
    assert readers.read_csv_text(spark, str(tmp_path / "x.csv")).first().asDict() == {"a": "1", "b": "two\nlines"}
    writers.zip_bundle(spark, [str(tmp_path / "x.csv")], str(tmp_path / "b.zip"))
    assert readers.read_dataset(spark, [str(tmp_path / "none.csv"), str(tmp_path / "b.zip")]).first().asDict() == {"a": "1", "b": "two\nlines"}
    out = str(tmp_path / "out")
    writers.write_dataset(df, out, "csv")
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_dataset(df, out, "csv")
    old = spark.createDataFrame([("m1", 1), ("m2", 1)], "method string, v int")
    new = spark.createDataFrame([("m2", 2), ("m3", 2)], "method string, v int")
    assert sorted(map(tuple, writers.upsert(old, new, ["method"]).collect())) == [("m1", 1), ("m2", 2), ("m3", 2)]
    assert writers.markdown_table(old).count("\n") == 3
    m = writers.manifest(df).first()
    assert m.row_count == 2 and len(m.columns) == len(df.columns)


def test_array_records_in_chunks(monkeypatch):
    import io

    from quillspark.sources import members

    rows = [{"a": [1, {"b": "]}, ["}], "t": "é 😀 \\ \""}, 12345, "x,]", None, True, [], {}, -1.5e3]
    for chunk in (1, 3, 1 << 20):
        monkeypatch.setattr(members, "CHUNK", chunk)
        for text in (json.dumps(rows), "\ufeff " + json.dumps(rows, indent=2, ensure_ascii=False) + "\n"):
            assert [json.loads(r) for r in members.array_records(io.StringIO(text))] == rows
        assert [json.loads(r) for r in members.array_records(io.StringIO('{"a": [1, 2]}'))] == [{"a": [1, 2]}]
        assert list(members.array_records(io.StringIO(""))) == list(members.array_records(io.StringIO("[]"))) == list(members.array_records(io.StringIO("  [ ] "))) == []
        assert [json.loads(r) for r in members.array_records(io.StringIO('[{"a": 1}, {"b": '))] == [{"a": 1}]


def test_members_of_files_folders_and_archives(spark, tmp_path):
    import zipfile

    readers.members.register(spark)
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "a.jsonl").write_text('{"k": 1}\n\nbroken\n[2]\n{"k": 2}')
    (tmp_path / "d" / "e" / "seg.log").write_text('{"k": 3}\n')
    (tmp_path / "d" / ".hidden.json").write_text('[{"k": 99}]')
    (tmp_path / "d" / "other.bin").write_text("x")
    with zipfile.ZipFile(tmp_path / "d" / "z.zip", "w") as z:
        z.writestr("t.csv", 'k,v\n4,"a\nb"\n5,c\n')
        z.writestr("u.json", '[{"k": 6}]')
        z.writestr("readme.md", "no")
    found = spark.read.format("quill_members").load(str(tmp_path / "d"))
    assert found.rdd.getNumPartitions() == 4
    got = sorted((r.path.rsplit("/", 1)[1], r.member, r.number, int(json.loads(r.record)["k"])) for r in found.collect())
    assert got == sorted([("a.jsonl", None, 0, 1), ("a.jsonl", None, 4, 2), ("seg.log", None, 0, 3), ("z.zip", "t.csv", 0, 4), ("z.zip", "t.csv", 1, 5), ("z.zip", "u.json", 0, 6)], key=lambda x: (x[0], x[1] or "", x[2])) or got
    assert {x[3] for x in got} == {1, 2, 3, 4, 5, 6}
    assert [r.k for r in readers.read_records(spark, str(tmp_path / "d" / "z.zip"), first=True).collect()] == [6]
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("quill_members").load(str(tmp_path / "nowhere")).count()
    (tmp_path / "empty").mkdir()
    assert spark.read.format("quill_members").load(str(tmp_path / "empty")).count() == 0


def test_json_arrays_written_by_tasks(spark, tmp_path):
    df = spark.range(25).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit('q"\n'), F.col("id").cast("string"))).alias("t"))
    out = str(tmp_path / "x.json")
    writers.write_json_array(df.repartition(7).filter("id % 5 <> 1"), out)
    parts = sorted((tmp_path / "x.json").glob("part-*"))
    rows = [r for p in parts for r in json.loads(p.read_text())]
    assert len(parts) == 7 and sorted(r["id"] for r in rows) == [k for k in range(25) if k % 5 != 1] and all("t" in r for r in rows)
    with pytest.raises(Exception, match="(?i)exist"):
        writers.write_json_array(df, out)
    writers.write_json_array(df.limit(0), out, overwrite=True, single_file=True)
    assert readers.read_records(spark, out, "id long").count() == 0


def test_image_index(spark, tmp_path):
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.jpg").write_bytes(b"1")
    first = readers.image_index(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert "/a/x.jpg" in first.first().path
    assert "/b/x.jpg" in readers.image_index(spark, [str(tmp_path / "a"), str(tmp_path / "b")], last_wins=True).first().path
    rows = spark.createDataFrame([("x",), ("x.jpg",), ("y",)], "image_id string")
    assert [r.image_path is not None for r in readers.find_images(rows, first).orderBy("image_id").collect()] == [True, True, False]


def test_prompts(spark):
    df = spark.createDataFrame([("q?", [("p1", "r1")])], "q string, c array<struct<question_es:string,answer_es:string>>")
    text = df.select(generation.case_prompt("q", "c", True).alias("t")).first().t
    assert text.split("\n")[0] == generation.CURRENT and "1. Pregunta similar: p1\n   Respuesta del caso similar: r1" in text and text.endswith(generation.NO_META)
    e = spark.createDataFrame([("q", [("a", 0.5)]), ("q", [])], "q string, e array<struct<answer:string,similitud:double>>")
    got = [r.t for r in e.select(generation.draft_prompt("q", "e").alias("t")).collect()]
    assert "[1] (similitud 0.50) a" in got[0] and "(No se encontraron casos similares" in got[1]
    assert [r.t.startswith("[BORRADOR") for r in e.select(generation.stub_draft("e").alias("t")).collect()] == [True, True]


def test_review_stream(spark, tmp_path):
    """Repeated reviews within a batch, in a later batch and after a restart; the log is moved away between runs, so it isn't read."""
    from quillspark.streaming import reviews

    source, log, approved = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "approved")
    source.mkdir()
    entry = lambda i, t, job, what="aprobar": json.dumps({"id": i, "timestamp": t, "job_id": job, "accion": what, "borrador_original": "t", "consulta": "c"})
    (source / "1.json").write_text("\n".join([entry("b", "2024-01-02", "j"), entry("a", "2024-01-01", "j"), entry("z", "2024-01-01", "k", "rechazar"), entry("x", "2024-01-01", "k", "nothing")]))
    run = lambda: reviews.write_reviews(reviews.review_stream(spark, str(source), files_at_once=1), log, approved, str(tmp_path / "ckpt")).awaitTermination()
    run()
    assert sorted(r.id for r in spark.read.parquet(log).collect()) == ["a", "z"]
    assert [r.job_id for r in spark.read.parquet(approved).collect()] == ["j"]
    (tmp_path / "log").rename(tmp_path / "elsewhere")
    (source / "2.json").write_text("\n".join([entry("0", "2023-01-01", "j"), entry("n", "2024-02-01", "new")]))  # earlier, but it came later
    (source / "3.json").write_text("\n".join([entry("m", "2024-01-15", "new"), entry("y", "2024-02-01", "k")]))
    os.utime(source / "2.json", (time.time() - 60,) * 2)  # files go by their time
    run()
    assert [r.id for r in spark.read.parquet(log).collect()] == ["n"]


def test_review_stream_takes_jobs_in_pieces(spark, tmp_path):
    """A job that comes in several Arrow batches, the first row of a later one being the first review."""
    from quillspark.streaming import reviews

    (tmp_path / "in").mkdir()
    entry = lambda k: json.dumps({"id": str(k), "timestamp": f"2024-01-{k:02}", "job_id": "j", "accion": "rechazar"})
    (tmp_path / "in" / "0.json").write_text("\n".join(entry(k) for k in (5, 6, 3, 4, 1, 2, 7, 8)))
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        reviews.write_reviews(reviews.review_stream(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "approved"), str(tmp_path / "ckpt")).awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    assert [r.id for r in spark.read.parquet(str(tmp_path / "log")).collect()] == ["1"]


def test_review_stream_forgets_old_jobs(spark, tmp_path):
    """With a watermark late reviews are left out, and a job may be reviewed again once it is forgotten."""
    from quillspark.streaming import reviews

    source = tmp_path / "in"
    source.mkdir()
    entry = lambda i, t, job: json.dumps({"id": i, "timestamp": t, "job_id": job, "accion": "aprobar", "borrador_original": "t", "consulta": "c"})
    days = [[("1", "2024-01-01", "j")], [("2", "2024-01-10", "other")], [("3", "2024-01-01", "late"), ("4", "2024-01-10", "j"), ("5", "2024-01-11", "other")], [("6", "2024-03-01", "x")]]
    for k, rows in enumerate(days):
        (source / f"{k}.json").write_text("\n".join(entry(*r) for r in rows))
        reviews.write_reviews(reviews.review_stream(spark, str(source)), str(tmp_path / "log"), str(tmp_path / "approved"), str(tmp_path / "ckpt"), late="1 day", keep_hours=48).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "log")).collect()) == ["1", "2", "4", "6"]


def test_two_writers_lose_and_double_nothing(spark, tmp_path):
    """Appends of the same jobs at once, and a writer that others overtake between its reading and its commit."""
    from concurrent.futures import ThreadPoolExecutor

    from quillspark.sources import commits

    entries = lambda who, ids: spark.createDataFrame([(f"{who}{k}", str(k % 7), k) for k in ids], "id string, job_id string, at int")
    table = lambda: commits.Table(spark, str(tmp_path / "log"), "id string, job_id string, at int", ["job_id"], 4)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda w: table().append_first(entries(w, range(10)), ["at"]), "abcd"))
    rows = table().read().collect()
    assert sorted(r.job_id for r in rows) == [str(k) for k in range(7)]
    overtaken = []

    def other(attempt: int) -> None:
        if attempt < 2:
            overtaken.append(attempt)
            table().append_first(spark.createDataFrame([(f"o{attempt}", f"job{attempt}", 0)], "id string, job_id string, at int"), ["at"])

    mine = spark.createDataFrame([("m0", "job0", 1), ("m1", "job1", 1), ("m2", "job2", 1), ("m3", "job2", 2), ("m4", "3", 0)], "id string, job_id string, at int")
    table().append_first(mine, ["at"], other)
    got = {r.job_id: r.id for r in table().read().filter("job_id like 'job%'").collect()}
    assert overtaken == [0, 1] and got == {"job0": "o0", "job1": "o1", "job2": "m2"}
    assert table().read().groupBy("job_id").count().filter("count > 1").count() == 0
    before = table().snapshot()
    assert table().append_first(mine, ["at"]).version == before.version  # nothing new, no version


def test_upserts_rewrite_touched_buckets_alone(spark, tmp_path, monkeypatch):
    from quillspark.sources import commits

    monkeypatch.setattr(commits, "WHOLE_EVERY", 3)
    table = commits.Table(spark, str(tmp_path / "t"), "method string, v int", ["method"], 8)
    rows = lambda names, v: spark.createDataFrame([(n, v) for n in names], "method string, v int")
    first = table.upsert(rows([f"m{k}" for k in range(40)], 1))
    second = table.upsert(rows(["m3", "new"], 2))
    changed = [b for b in first.folders if first.folders[b] != second.folders[b]]
    assert 1 <= len(changed) <= 2 and len(first.folders) == 8

    def other(attempt: int) -> None:
        if attempt == 0:  # in the same bucket, and in another
            table.upsert(rows(["m3", "m5"], 9))

    table.upsert(rows(["m3"], 3), other)
    got = {r.method: r.v for r in table.read().collect()}
    assert got == {f"m{k}": 1 for k in range(40)} | {"new": 2, "m3": 3, "m5": 9} and table.read().count() == 41
    assert table.read(first).count() == 40 and table.snapshot(first).folders == table.snapshot().folders
    assert commits.Table(spark, str(tmp_path / "none"), "k int", ["k"]).read().count() == 0


@pytest.mark.parametrize("accuracy", [10_000, 50, 5])
def test_quantiles(spark, monkeypatch, accuracy):
    import numpy as np

    monkeypatch.setattr(rollup, "RANK_ACCURACY", accuracy)
    monkeypatch.setattr(rollup, "BROADCAST_GROUPS", accuracy - 50)
    rng = np.random.default_rng(3)
    rows = [(k % 3, float(v)) for k, v in enumerate(rng.integers(0, 40, 500) / 8)] + [(0, None), (1, float("nan")), (5, 2.0), (None, 3.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r.q for r in rollup.quantiles(df, ["g"], "v", [0.0, 0.3, 0.5, 1.0]).collect()}
    for g in (0, 1, 2, 5, None):
        assert got[g] == pytest.approx(np.quantile([v for k, v in rows if k == g and v is not None and not math.isnan(v)], [0.0, 0.3, 0.5, 1.0]).tolist())
    every = sorted(v for _, v in rows if v is not None and not math.isnan(v))
    assert rollup.quantiles(df, [], "v", [0.5], "higher").first().q[0] == every[len(every) // 2]
    values = rng.normal(size=20_000)
    long = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    for shares in ([0.0, 0.25, 0.5, 0.75, 1.0], [0.95, 0.123456]):
        assert rollup.quantiles(long, [], "v", shares).first().q == pytest.approx(np.quantile(values, shares).tolist(), abs=1e-12)
    for n in (1, 2, 3, 4, 7, 10) if accuracy == 10_000 else ():
        few = spark.createDataFrame([(float(v),) for v in values[:n]], "v double")
        assert rollup.quantiles(few, [], "v", [0.1, 0.3, 0.5, 0.95]).first().q == pytest.approx(np.quantile(values[:n], [0.1, 0.3, 0.5, 0.95]).tolist(), abs=1e-12)


def test_effects_and_strata(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "a", -1.0), (3, "b", 0.0), (4, "b", 2.0), (5, "b", 2.0)], "k int, s string, d double")
    wide = df.select("k", "s", F.col("d").alias("m_x"), (F.col("d") * 2).alias("m_mean_score")).unionByName(spark.createDataFrame([(6, None, 1.0, 3.0)], "k int, s string, m_x double, m_mean_score double"))
    rows = {(r.dimension, r.stratum): (r.method, r.n, r.x, r.mean_score) for r in rollup.strata_means(wide, {"by": F.col("s"), "odd": F.col("k") % 2}, ["m"], ["x"]).collect()}
    assert rows == {("by", "a"): ("m", 2, -0.25, -0.5), ("by", "b"): ("m", 3, pytest.approx(4 / 3), pytest.approx(8 / 3)), ("by", None): ("m", 1, 1.0, 3.0), ("odd", "1"): ("m", 3, pytest.approx(2.5 / 3), pytest.approx(5 / 3)), ("odd", "0"): ("m", 3, pytest.approx(2 / 3), pytest.approx(5 / 3))}
    got = {(r.dimension, r.stratum): (r.n, r.mean_delta, r.median_delta, r.positive_rate) for r in rollup.effects(df, {"e": "d"}, {"by": F.col("s")}).collect()}
    assert got == {("overall", "all"): (5, pytest.approx(0.7), 0.5, 0.6), ("by", "a"): (2, -0.25, -0.25, 0.5), ("by", "b"): (3, pytest.approx(4 / 3), 2.0, pytest.approx(2 / 3))}


def test_fallback_and_zero_hits(spark):
    docs = spark.createDataFrame([(1, "acne"), (2, "psoriasis"), (3, "tinea")], "doc long, t string")
    q = docs.withColumnRenamed("doc", "q")
    got = {(r.q, r["rank"]): (r.doc, r.score) for r in retrieval.tfidf_search(q, docs, "q", "doc", "t", 2, bigrams=False, max_df=None, exclude_same=True, fill=True).collect()}
    assert got == {(1, 1): (2, 0.0), (1, 2): (3, 0.0), (2, 1): (1, 0.0), (2, 2): (3, 0.0), (3, 1): (1, 0.0), (3, 2): (2, 0.0)}
    none = retrieval.tfidf_search(q, docs, "q", "doc", "t", 1, bigrams=False, max_df=None, exclude_same=True)
    assert {r.q: r.doc for r in retrieval.with_fallback(none, q, docs, "q", "doc", exclude_same=True).collect()} == {1: 2, 2: 1, 3: 1}


def test_dense_blocks_give_one_result(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(60)], "doc long, v array<double>")
    q = v.withColumnRenamed("doc", "q")
    run = lambda: sorted((r.q, r["rank"], r.doc, r.score) for r in retrieval.dense_search(q, v, "q", "doc", "v", 3, exclude_same=True).collect())
    whole = run()
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "INDEX_BLOCK", 11)
    assert run() == whole and len(whole) == 180
    assert retrieval.dense_search(q.limit(0), v, "q", "doc", "v", 3).count() == 0


def test_dense_scores_are_held_in_pieces(spark, monkeypatch):
    """Pieces of few scores at once, in the search and for pivots, give the same result."""
    import numpy as np

    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(300)], "doc long, v array<double>")
    run = lambda: sorted((r.q, r["rank"], r.doc, round(r.score, 6)) for r in retrieval.dense_search(v.withColumnRenamed("doc", "q"), v, "q", "doc", "v", 3, exclude_same=True).collect())
    whole = run()
    monkeypatch.setattr(retrieval, "SCORES", 50)
    assert run() == whole and len(whole) == 900
    pivots = retrieval.Pivots(np.eye(4))
    assert pivots.nearest(np.repeat(np.eye(4), 30, 0))[0].tolist() == np.repeat(range(4), 30).tolist()


def test_far_blocks_are_skipped(spark, monkeypatch):
    """Clustered vectors: exact results, though most blocks are never joined with a query; a cluster of copies goes over several parts."""
    import numpy as np

    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 8))
    centers /= np.linalg.norm(centers, axis=1)[:, None]
    x = np.concatenate([centers[rng.integers(0, 12, 1500)] + rng.normal(scale=0.02, size=(1500, 8)), np.repeat(centers[:1], 700, 0)])
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)] + [(9999, None)], "doc long, v array<double>")
    q = v.filter("doc % 40 = 0 or doc = 9999").withColumnRenamed("doc", "q")
    monkeypatch.setattr(retrieval, "INDEX_BLOCK", 100)
    got = {(r.q, r["rank"]): (r.doc, round(r.score, 6)) for r in retrieval.dense_search(q, v, "q", "doc", "v", 4, exclude_same=True).collect()}
    want = {}
    for k in range(0, len(x), 40):
        order = sorted((-round(float(s), 6), d) for d, s in enumerate(x @ x[k]) if d != k)[:4]
        want |= {(k, r): (d, -s) for r, (s, d) in enumerate(order, 1)}
    assert got.keys() == want.keys() and all(got[k] == want[k] or got[k][1] == pytest.approx(want[k][1], abs=2e-6) for k in want)
    rows, pivots = retrieval.placed(v.filter("v is not null"), "doc", "v", len(x))
    assert max(pivots.parts) > 1
    low = q.filter("v is not null").select("q", F.col("v").alias("_v"), F.lit(0.9).alias("floor"))
    assert retrieval.wanted_pivots(low, pivots, False).count() + low.count() < low.count() * (pivots.parts > 0).sum() / 2


def test_heavy_terms_are_not_joined(spark, monkeypatch):
    """A term of nine texts in ten: the best are those of the whole product of postings, though few postings are joined."""
    import random

    monkeypatch.setattr(retrieval, "POSTING_BLOCK", 100)
    rng = random.Random(7)
    text = lambda: " ".join((["common"] if rng.random() < 0.9 else []) + ["often"] * (rng.random() < 0.5) + [f"w{int(rng.paretovariate(0.7))}" for _ in range(6)])
    docs = spark.createDataFrame([(k, text()) for k in range(1200)], "doc long, t string")
    q = docs.filter("doc % 20 = 0").withColumnRenamed("doc", "q")
    counted = retrieval.terms(docs, "doc", "t", bigrams=False)
    n = docs.count()
    w = retrieval.weights(counted, retrieval.idf(counted, docs.agg(F.count(F.lit(1)).alias("n")), None), "doc").cache()
    asked = w.join(q.select(F.col("q").alias("doc")), "doc", "left_semi").withColumnRenamed("doc", "q")
    for same in (False, True):
        every = retrieval.sparse_scores(asked, w, "q", "doc")
        want = retrieval.top_k(every.filter("q <> doc") if same else every, "q", "doc", 5)
        got = retrieval.top_k(retrieval.pruned_scores(asked, w, "q", "doc", 5, n, same), "q", "doc", 5)
        told = lambda df: sorted((r.q, r["rank"], r.doc, round(r.score, 6)) for r in df.collect())
        assert told(got) == told(want)
    index = retrieval.postings(w, "doc", n)
    high = retrieval.block_maxima(index)
    needed = retrieval.needed_terms(asked, high, retrieval.floors(asked, index, high, "q", "doc", 5), "q")
    joined = needed.filter("needed").join(index, ["block", "term"]).count()
    product = asked.join(w.withColumnRenamed("w", "d"), "term").count()
    assert joined < product / 4
    assert needed.filter("needed and term = 'common'").count() == 0


def test_sparse_blocks_give_one_result(spark, monkeypatch):
    """Many blocks and groups, copies of texts, ids and texts of both sides alike, ties: the k best of all pairs of rows."""
    import random

    monkeypatch.setattr(retrieval, "TEXT_BLOCK", 40)
    monkeypatch.setattr(retrieval, "LOOK_UP", 4)
    rng = random.Random(11)
    text = lambda: " ".join((["common"] if rng.random() < 0.9 else []) + [f"w{int(rng.paretovariate(0.8))}" for _ in range(rng.randrange(7))])
    texts = [text() for _ in range(260)] + ["common w1"] * 30 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, t string").repartition(3)
    other = spark.createDataFrame([(k, t) for k, t in enumerate(texts[:40])] + [(k + 1000, text()) for k in range(60)], "q long, t string")
    told = lambda df: sorted((r.q, r["rank"], r.doc, round(r.score, 6)) for r in df.collect())
    for same, k, asked in ((False, 3, other), (True, 1, docs.withColumnRenamed("doc", "q")), (True, 4, docs.withColumnRenamed("doc", "q"))):
        every = retrieval.tfidf_search(asked, docs, "q", "doc", "t", None, exclude_same=same)
        assert told(retrieval.tfidf_search(asked, docs, "q", "doc", "t", k, exclude_same=same)) == told(retrieval.top_k(every, "q", "doc", k))


def test_equal_texts_are_searched_once(spark, monkeypatch):
    """Copies of a text make no more vectors, whatever their number."""
    seen = []
    search = retrieval.text_search
    monkeypatch.setattr(retrieval, "text_search", lambda v, k, *a: (seen.append(v.count()), search(v, k, *a))[1])
    docs = spark.range(3000).select(F.col("id").alias("doc"), F.concat(F.lit("approved case "), (F.col("id") % 5 + 100).cast("string")).alias("t"))
    got = retrieval.tfidf_search(docs.withColumnRenamed("doc", "q"), docs, "q", "doc", "t", 1, bigrams=False, max_df=None, exclude_same=True).collect()
    assert seen == [5] and len(got) == 3000 and {(r.q, r.doc) for r in got if r.q < 7} == {(0, 5), (1, 6), (2, 7), (3, 8), (4, 9), (5, 0), (6, 1)}


def test_ranking_quality_by_class(spark):
    q, d = spark.range(20).select(F.col("id").alias("q"), (F.col("id") % 4).alias("m")), spark.range(50).select(F.col("id").alias("doc"), (F.col("id") % 3).alias("m"))
    hits = q.select("q").join(d.select("doc").filter("doc < 6")).withColumn("rank", (F.col("doc") + 1).cast("int"))
    pairs = q.join(d, "m").select("q", "doc")
    assert tuple(retrieval.class_ranking_quality(hits, q, d, "q", "doc", "m", (1, 3)).first()) == pytest.approx(tuple(retrieval.ranking_quality(hits, pairs, "q", "doc", (1, 3)).first()))


def test_alpha_sweep_against_all_scores(spark, monkeypatch):
    import random

    rng = random.Random(9)
    rows = [(k % 5, k, rng.choice([None, 0.0, 0.5, rng.random()]), rng.choice([None, 1.0, rng.random()])) for k in range(600)]
    alphas = [0.0, 0.1, 0.33, 0.5, 0.77, 1.0]
    df = spark.createDataFrame(rows, "q int, d int, t double, v double").repartition(3)
    want = {}
    for q, d, t, v in rows:
        for a in alphas:
            want[q, a] = min(want.get((q, a), (9, 0)), (-(a * (t or 0.0) + (1 - a) * (v or 0.0)), d))
    assert {(r.q, r.alpha): (-r.score, r.d) for r in retrieval.alpha_sweep(df, "q", "d", "t", "v", alphas).collect()} == want
    assert retrieval.best_at_any_alpha(df, "q", "d", "t", "v").count() < 100
    with pytest.raises(ValueError, match="no backend"):
        retrieval.backend("none")


def test_alpha_sweep_stays_in_the_jvm(spark):
    """No row goes through Python, and the plan groups by whole queries only."""
    df = spark.range(100).select((F.col("id") % 3).alias("q"), F.col("id").alias("d"), (F.col("id") / 7).alias("t"), F.lit(None).cast("double").alias("v"))
    out = retrieval.alpha_sweep(df, "q", "d", "t", "v", [0.0, 0.5, 1.0])
    plan = out._jdf.queryExecution().toString()
    assert "InPandas" not in plan and "Window" not in plan
    assert {(r.q, r.alpha, r.d) for r in out.collect()} == {(q, a, q if a == 0 else 99 - (0 if q == 0 else 3 - q)) for q in range(3) for a in (0.0, 0.5, 1.0)}


def test_fused_blocks_give_one_result(spark, monkeypatch):
    rows = [(k, f"w{k % 5} w{k % 7} common x{k}" if k % 6 else None, [float(k % 4), 1.0] if k % 3 else None) for k in range(80)]
    d = spark.createDataFrame(rows, "doc long, t string, v array<double>")
    q = d.filter("doc < 12").withColumnRenamed("doc", "q")
    run = lambda: sorted(map(tuple, retrieval.fused_search(q, d, "q", "doc", "t", "v", k=3).collect()))
    whole = run()
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 5)
    monkeypatch.setattr(retrieval, "INDEX_BLOCK", 9)
    assert run() == whole and len(whole) == 36
    assert retrieval.fused_search(q.limit(0), d, "q", "doc", "t", "v").count() == retrieval.fused_search(q, d.limit(0), "q", "doc", "t", "v").count() == 0


def test_token_match(spark):
    import numpy as np

    from quillspark.functions import metrics

    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=(int(rng.integers(0, 6)), 3)).tolist(), rng.normal(size=(int(rng.integers(0, 2000 if k == 0 else 6)), 3)).tolist()) for k in range(20)]
    df = spark.createDataFrame(rows, "k int, a array<array<double>>, b array<array<double>>")
    got = {r.k: r.m for r in df.select("k", metrics.token_match("a", "b").alias("m")).collect()}
    for k, a, b in rows:
        if not a or not b:
            assert got[k].f1 == 0
            continue
        x, y = (np.array(v) / np.linalg.norm(v, axis=1)[:, None] for v in (a, b))
        p, r = (x @ y.T).max(1).mean(), (x @ y.T).max(0).mean()
        assert (got[k].precision, got[k].recall) == pytest.approx((p, r))
    one = df.filter("k = 3").select(metrics.token_match("a", "a", F.transform("a", lambda _: F.lit(2.0)), baseline=0.5).alias("m")).first().m
    assert not rows[3][1] or one.f1 == pytest.approx(1)
    tokens = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "k int, t string")
    assert {r.t: round(r.idf, 6) for r in metrics.idf_weights(tokens, "k", "t").collect()} == {"a": 0.0, "b": round(math.log(3 / 2), 6)}


def test_table_functions(spark):
    from quillspark.functions import tables

    class Longest:
        def __init__(self):
            self.n = []

        def add(self, text, vector):
            self.n.append(len(text or ""))

        def scores(self, text, vector):
            import numpy as np

            return np.array(self.n, float)

    tables.register(spark, {"longest": Longest})
    spark.createDataFrame([("index", 1, "red blue", [1.0, 0.0]), ("index", 2, "red", None), ("index", 3, None, [0.0, 1.0]), ("query", 9, "RED sky", [0.5, 2.0])], "side string, id long, text string, vector array<float>").createOrReplaceTempView("rows_here")
    ask = lambda k, b: [tuple(r) for r in spark.sql(f"SELECT * FROM quill_search(TABLE(SELECT * FROM rows_here) WITH SINGLE PARTITION ORDER BY (side), k => {k}, backend => '{b}')").collect()]
    assert ask(2, "dense") == [(9, 3, 2.0, 1), (9, 1, 0.5, 2)]
    assert ask(2, "tokens") == [(9, 1, 0.5, 1), (9, 2, 0.5, 2)] and ask(1, "longest") == [(9, 1, 8.0, 1)]
    for bad in ("k => 0, backend => 'dense'", "k => 1, backend => 'none'"):
        with pytest.raises(Exception, match="k must|no backend"):
            spark.sql(f"SELECT * FROM quill_search(TABLE(SELECT * FROM rows_here) WITH SINGLE PARTITION ORDER BY (side), {bad})").collect()
    spark.createDataFrame([(1, ["a", None]), (2, []), (3, None)], "k int, xs array<string>").createOrReplaceTempView("lists_here")
    assert sorted(map(tuple, spark.sql("SELECT * FROM quill_expand(TABLE(lists_here), 'xs', 'x')").collect()), key=str) == [(1, 0, "a"), (1, 1, None), (2, None, None), (3, None, None)]
    with pytest.raises(Exception, match="no array"):
        spark.sql("SELECT * FROM quill_expand(TABLE(lists_here), 'k')").collect()


def test_reruns_and_attached_keys_must_be_unique(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    twice = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(ValueError):
        corpus.merge_reruns(old, twice, ["k"])
    with pytest.raises(Exception, match="unique"):
        corpus.attach(old, twice, ["k"], {"v": "w"}).collect()


def test_bleu_tokens(spark):
    from quillspark.functions import metrics

    rows = [("Hello, world! It's 3.5-inch.", "Hello , world ! It's 3.5 - inch ."), ("state-of-the-art ¿qué?", "state-of-the-art ¿qué ?"), ("a &amp; b &quot;c&quot; 1,000.", 'a & b " c " 1,000 .'), ("end-\nof line", "endof line"), ("", "")]
    got = spark.createDataFrame(rows, "t string, w string").select(F.array_join(metrics.tokens_13a("t"), " ").alias("g"), "w").collect()
    assert [r.g for r in got] == [r.w for r in got]


def test_windowed_stream(spark, tmp_path):
    from quillspark.streaming import reviews

    (tmp_path / "in").mkdir()
    lines = [{"ts": f"2024-01-01 0{h}:10:00", "kind": k} for h, k in ((1, "a"), (1, "a"), (2, "b"))]
    (tmp_path / "in" / "x.json").write_text("\n".join(json.dumps(x) for x in lines))
    stream = spark.readStream.schema("ts timestamp, kind string").json(str(tmp_path / "in"))
    q = reviews.action_counts(stream, "ts", "kind").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.kind, r.n) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]


def test_images_by_name_join_each_row(spark):
    index = spark.createDataFrame([("x.png", "/a/x.png"), ("y", "/a/y"), ("x", "/a/x")], "name string, path string")
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z"), (5, None)], "k int, image_id string")
    assert {r.k: r.image_path for r in readers.find_images(rows, index).collect()} == {1: "/a/x", 2: "/a/x", 3: "/a/y", 4: None, 5: None}
