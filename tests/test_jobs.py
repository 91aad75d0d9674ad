
from newsloom.plans import jobs
from newsloom.plans.ingestq import raw_articles
from newsloom.sources import files
from tests.conftest import SF001


def test_processor_is_idempotent_and_records_reasons(spark):
    root = files.scratch_dir(spark, "proc-test")
    raw_articles(spark, SF001).write.partitionBy("lang_dir", "outlet_dir", "run_ts").json(f"{root}/landing")
    first = jobs.processor_run(spark, f"{root}/landing", f"{root}/seen", f"{root}/out", "en", "20240113_070000")
    n1 = first.count()
    assert n1 > 0
    seen = files.load_seen(spark, f"{root}/seen")
    assert set(r.reason for r in seen.select("reason").distinct().collect()) <= {"enriched", "exact_copy", "near_duplicate"}
    # every processed url is recorded as seen, so a second run finds nothing new
    assert first.join(seen, "url", "left_anti").count() == 0
    second = jobs.processor_run(spark, f"{root}/landing", f"{root}/seen", f"{root}/out", "en", "20240114_070000")
    assert second.count() == 0


def test_loader_decides_every_row(spark):
    out = jobs.loader_run(spark, None, raw_articles(spark, SF001).select("source", "title", "url", "summary"),
                          spark.createDataFrame([], "id long, url string, vec array<float>, inserted_at timestamp"),
                          "2024-01-27 00:00:00")
    rows = out.collect()
    assert len(rows) == raw_articles(spark, SF001).count()
    ins = sorted(r.new_id for r in rows if r.decision == "inserted")
    assert ins == list(range(1, len(ins) + 1))
