import json
import os

import pytest
from pyspark.sql import functions as F

from evidex.operators.cascade import Reference
from evidex.sinks import versions
from evidex.sources import files

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    """Pages as html files, conversations as subtitles and json."""
    for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").limit(6).collect():
        (tmp_path / f"{r.page_id}.{'HTM' if r.page_id % 2 else 'html'}").write_text(r.html)
    (tmp_path / "sub").mkdir()
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").limit(4).collect():
        (tmp_path / "sub" / f"{r.conv_id}-{r.turn}.vtt").write_text("WEBVTT\n\n00:00:01.000 --> 00:00:02.000\n" + r.text.replace("\n", " ") + "\n")
        (tmp_path / "sub" / f"{r.conv_id}-{r.turn}.json").write_text(json.dumps({"role": r.role, "text": r.text}))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "big.html").write_text("x" * 60_000)
    (tmp_path / "film.mp4").write_bytes(b"\xff" * 100)
    (tmp_path / "notes.txt").write_text("not evidence")
    return tmp_path


def test_files_come_back_by_their_kind(spark, folder):
    limits = files.LIMITS | {"html": (50_000, "html_size_limit"), "media": (99, "local_media_too_large")}
    found = files.files(spark, str(folder), limits=limits)
    rows = {os.path.basename(r.path): r for r in files.evidence(found).withColumns({"title": F.col("page.title"), "role": F.try_variant_get("document", "$.role", "string")}).drop("document").collect()}
    assert len(rows) == 6 + 8 + 3 and "notes.txt" not in rows
    assert rows["big.html"].code == "html_size_limit" and rows["big.html"].text is None and rows["big.html"].size == 60_000 and rows["big.html"].page is None
    assert rows["film.mp4"].code == "local_media_too_large" and rows["bad.json"].code == "json_invalid"
    whole = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for name, r in rows.items():
        if r.kind == "html" and r.code is None:
            assert r.text == whole[int(name.split(".")[0])] and r.page is not None
    told = {f"{r.conv_id}-{r.turn}": r for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    subtitles = {n.split(".")[0]: r.transcript for n, r in rows.items() if r.kind == "subtitle"}
    assert len(subtitles) == 4 and all(" ".join(t.split()) == " ".join(told[n].text.split()) for n, t in subtitles.items())
    assert all(r.role == told[n.split(".")[0]].role for n, r in rows.items() if r.kind == "json" and r.code is None)


def test_other_suffixes_and_large_contents_are_not_read(spark, folder):
    only = files.files(spark, str(folder), ("html",))
    assert {r.suffix for r in only.select("suffix").collect()} == {"html", "htm"}
    plan = files.files(spark, str(folder), ("html",), limits={"html": (10, "html_size_limit")}).select("path", "code").where("code is not null")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [GreaterThan(length,10)]" in plan.replace("IsNotNull(length), ", "") and "content" not in plan.split("ReadSchema")[-1]


def test_no_files(spark, tmp_path):
    assert files.evidence(files.files(spark, str(tmp_path))).count() == 0


REFERENCE = Reference("steps", ("recipe",), "recipes", ("id",))


def frames(spark, n, broken=False):
    fail = F.udf(lambda i: 1 // 0 if broken and i == 2 else i, "int")
    return {"recipes": spark.createDataFrame([(i, f"v{n}") for i in range(n)], "id int, title string"), "steps": spark.createDataFrame([(i, i % n) for i in range(3 * n)], "step int, recipe int").withColumn("step", fail("step"))}


def test_tables_are_published_together(spark, tmp_path):
    folder = f"file://{tmp_path}/library"
    with pytest.raises(FileNotFoundError):
        versions.read(spark, folder, "recipes")
    assert versions.publish(spark, folder, frames(spark, 2), references=[REFERENCE]) == 1
    with pytest.raises(Exception, match="division"):
        versions.publish(spark, folder, frames(spark, 4, broken=True))
    counts = lambda number=None: (versions.read(spark, folder, "recipes", number=number).count(), versions.read(spark, folder, "steps", number=number).count())
    assert counts() == (2, 6)
    with pytest.raises(versions.Orphans):
        versions.publish(spark, folder, frames(spark, 3) | {"recipes": frames(spark, 1)["recipes"]}, references=[REFERENCE])
    assert counts() == (2, 6)
    assert versions.publish(spark, folder, frames(spark, 3), after=1) == 2
    with pytest.raises(versions.Conflict):
        versions.publish(spark, folder, frames(spark, 5), after=1)
    assert counts() == (3, 9) and counts(1) == (2, 6)
    assert versions.publish(spark, folder, {"recipes": frames(spark, 1)["recipes"].limit(0), "steps": frames(spark, 1)["steps"].limit(0)}) == 3
    assert counts() == (0, 0)
    assert versions.collect(spark, folder, keep=1) == 5 and counts() == (0, 0) and versions.manifests(spark, folder) == [3]
