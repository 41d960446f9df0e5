"""Queries on jobs, page windows and outcomes of attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import textops as T
from tessera.operators import jobs as J
from tessera.plans import tables as R
from tessera.session import read

RESTART = 1_750_000_000.0  # when the process of these queries began, in epoch seconds


def str_job_states(spark, d):
    """STR-02: state of every job after a restart."""
    return J.job_states(read(spark, d, "jobs"), F.lit(RESTART)).select("job_id", "status", "error")


def str_job_status(spark, d):
    """STR-03, TOOL-11: what is told of every job."""
    return J.job_status(J.job_states(read(spark, d, "jobs")))


def str_jobs_retained(spark, d):
    """STR-02: jobs that retention keeps at the restart."""
    return J.retained(J.job_states(read(spark, d, "jobs")), F.lit(RESTART)).select("job_id", "status")


def _documents(spark, d):
    """Latest build of each package: doc_id, pages, and whether its runs were scans."""
    scans = read(spark, d, "extract_reports").where("doc_id is not null").groupBy("doc_id").agg(F.max(F.try_element_at("metadata", F.lit("force_ocr")) == "true").alias("scanned"))
    p = read(spark, d, "package_metadata").where("doc_id is not null").groupBy("doc_id").agg(F.max("pages").alias("pages"))
    return p.join(scans, "doc_id", "left").select("doc_id", F.col("pages").alias("page_count"), F.coalesce("scanned", F.lit(False)).alias("scanned"))


def str_mode(spark, d):
    """STR-04, STR-08: whether each document is converted in the background, its minutes, and the seconds allowed of 900."""
    docs = _documents(spark, d)
    pages, scanned = F.col("page_count"), F.col("scanned")
    return docs.select("doc_id", J.runs_in_background(pages, F.lit(None).cast("string")).alias("background"), J.minutes_needed(pages, scanned).alias("minutes"), J.seconds_allowed(F.lit(900), pages, scanned).alias("seconds"))


def _long_documents(spark, d):
    return _documents(spark, d).withColumn("page_count", F.col("page_count") * 7)


def seq_page_windows(spark, d):
    """SEQ-17: windows of documents of sevenfold length."""
    return J.page_windows(_long_documents(spark, d), "doc_id")


def seq_half_windows(spark, d):
    """SEQ-18: the halves of these windows."""
    return J.halves(J.page_windows(_long_documents(spark, d), "doc_id"), "doc_id")


def str_checkpoints(spark, d):
    """STR-05: windows left to do after a run that finished every second one, and one window with other parameters."""
    windows = J.page_windows(_long_documents(spark, d), "doc_id").withColumn("params_hash", F.substring(F.md5("doc_id"), 1, 8))
    done = windows.where("window_no % 2 = 0").withColumn("params_hash", F.when(F.col("last") % 5 == 0, "other").otherwise(F.col("params_hash")))
    return J.to_do(windows, done, "doc_id").select("doc_id", "window_no", "first", "last")


def attempts(spark, d):
    """Attempts on each window of these documents, as the hash of the document has them fail."""
    w = J.page_windows(_long_documents(spark, d), "doc_id")
    h = F.conv(F.substring("doc_id", 1, 4), 16, 10).cast("int") + F.col("window_no")
    w = w.withColumn("h", h).withColumn("layer_chars", F.when(F.col("h") % 3 == 0, 300).otherwise(20))
    steps = w.select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("step"))
    ok = F.when(F.col("step") == 1, F.col("h") % 2 == 0).when(F.col("step") == 2, F.col("h") % 5 == 0).otherwise(F.col("h") % 7 != 0)
    text = F.concat(F.lit("step "), F.col("step").cast("string"), F.when(F.col("step") == 3, F.repeat(F.lit(" layer"), 800)).otherwise(""))
    whole = steps.select("doc_id", "window_no", "first", "last", "step", ok.alias("ok"), text.alias("text"), "layer_chars")
    parts = J.halves(w, "doc_id").join(w.select("doc_id", "window_no", "h", "layer_chars"), ["doc_id", "window_no"])
    halves = parts.select("doc_id", "window_no", "first", "last", F.lit(4).alias("step"), ((F.col("h") + F.col("half")) % 4 != 1).alias("ok"), F.concat(F.lit("half "), F.col("half").cast("string")).alias("text"), "layer_chars")
    return whole.unionByName(halves)


def str_ladder(spark, d):
    """STR-06: outcome of each window after its attempts."""
    return J.settle(attempts(spark, d), "doc_id")


def str_batch_report(spark, d):
    """STR-01, AGG-09: all outcomes in one row."""
    return J.batch_report(J.settle(attempts(spark, d), "doc_id"))


def scl_flags(spark, d):
    """SCL-27: the tri-state flag of every job's parameters, with recognition configured for conversions and the policy on."""
    j = read(spark, d, "jobs").select("job_id", "kind", F.get_json_object("params", "$.force_ocr").alias("flag")).distinct()
    return j.select("job_id", "flag", T.tri_state(F.col("flag"), F.col("kind") == "convert", F.lit(True)).alias("on"))


def scl_json(spark, d):
    """SCL-30: each report's run as one JSON object, nulls written."""
    r = R.reports(spark, d)
    return r.select("report_id", T.json_object(F.col("report_id"), F.col("doc_id"), F.col("page_count"), names=("report_id", "doc_id", "page_count")).alias("json"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith(("str_", "seq_", "scl_")) and callable(v)}

STATES = """s as (select job_id, max_by(struct_pack(kind, status, stage, params, created_at, started_at, finished_at, error), struct_pack(a := coalesce(finished_at, started_at, created_at), status)) as j from jobs where job_id is not null group by 1)"""
DOCS = """p as (select doc_id, max(pages) as pages from package_metadata where doc_id is not null group by 1),
c as (select doc_id, max(coalesce(metadata['force_ocr'], '') = 'true') as scanned from extract_reports where doc_id is not null group by 1),
docs as (select p.doc_id, pages, coalesce(scanned, false) as scanned from p left join c on c.doc_id = p.doc_id)"""
WINDOWS = f"""{DOCS}, n as (select doc_id, greatest(coalesce(pages * 7, 0), 1) as n from docs),
w as (select doc_id, k::int as window_no, (k * 80)::int as "first", (case when n <= 100 then n - 1 else least(k * 80 + 80, n) - 1 end)::int as "last" from n, unnest(range(case when n <= 100 then 1 else (n - 1) // 80 + 1 end)) as u(k))"""
MISSING = "'[pages ' || (\"first\" + 1) || '-' || (\"last\" + 1) || ' are missing]'"
LADDER = f"""{WINDOWS}, h as (select *, ('0x' || substr(doc_id, 1, 4))::int + window_no as h from w),
o as (select *, h % 2 = 0 as one, h % 5 = 0 as two, h % 7 <> 0 as three, h % 3 = 0 as layer, h % 4 <> 1 as a, "last" = "first" or (h + 1) % 4 <> 1 as b, ("first" + "last") // 2 as m from h),
outcome as (select doc_id, window_no,
    case when one or two then 'ok' when layer and three and 6 + 4800 >= 50 * ("last" - "first" + 1) then 'degraded' when not layer and a and b then 'ok' else 'missing' end as status,
    case when one then 'step 1' when two then 'step 2' when layer and three and 6 + 4800 >= 50 * ("last" - "first" + 1) then 'step 3' || repeat(' layer', 800)
         when not layer then (case when a then 'half 0' else '[pages ' || ("first" + 1) || '-' || (m + 1) || ' are missing]' end)
            || case when "last" = "first" then '' else chr(10) || chr(10) || case when b then 'half 1' else '[pages ' || (m + 2) || '-' || ("last" + 1) || ' are missing]' end end
         else {MISSING} end as text from o)"""

SQL = {
    "str_job_states": f"with {STATES} select job_id, case when lost then 'failed' else j.status end as status, case when lost then 'interrupted' else j.error end as error from (select *, j.status in ('queued', 'running') and coalesce(j.started_at, j.created_at) < {RESTART} as lost from s)",
    "str_job_status": f"with {STATES} select job_id, j.kind as kind, j.status as status, j.stage as stage, round(j.finished_at - j.started_at, 1) as seconds, substr(coalesce(j.error, j.params), 1, 2000) as preview from s",
    "str_jobs_retained": f"with {STATES} select job_id, j.status as status from s where j.status in ('queued', 'running') union all (select job_id, j.status from s where j.status not in ('queued', 'running') and j.created_at >= {RESTART} - 30 * 86400 order by j.created_at desc, job_id limit 500)",
    "str_mode": f"with {DOCS} select doc_id, coalesce(pages, 0) > 15 as background, round(coalesce(pages, 0) * case when scanned then 1.5 else 0.4 end::double, 1) as minutes, case when scanned then greatest(900, coalesce(pages, 0) * 90) else 900 end as seconds from docs",
    "seq_page_windows": f'with {WINDOWS} select doc_id, window_no, "first", "last" from w',
    "seq_half_windows": f'with {WINDOWS} select doc_id, window_no, half, "first", "last" from (select doc_id, window_no, 0 as half, "first", ("first" + "last") // 2 as "last" from w union all select doc_id, window_no, 1, ("first" + "last") // 2 + 1, "last" from w) where "first" <= "last"',
    "str_checkpoints": f'with {WINDOWS} select doc_id, window_no, "first", "last" from w where not (window_no % 2 = 0 and "last" % 5 <> 0)',
    "str_ladder": f"with {LADDER} select doc_id, window_no, status, text from outcome",
    "str_batch_report": f"with {LADDER} select count(*) as total, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'degraded') as degraded, count(*) filter (status = 'missing') as missing from outcome",
    "scl_flags": """with f as (select distinct job_id, kind, json_extract_string(params, '$.force_ocr') as flag from jobs)
select job_id, flag, case when lower(trim(flag)) in ('true', 'on', 'yes', '1') then true when lower(trim(flag)) in ('false', 'off', 'no', '0') then false else kind = 'convert' end as "on" from f""",
    "scl_json": "with r as (select report_id, any_value(doc_id) as doc_id, max(page_count) as page_count from extract_reports where full_text_md is not null group by 1) select report_id, '{\"report_id\":\"' || report_id || '\",\"doc_id\":' || coalesce('\"' || doc_id || '\"', 'null') || ',\"page_count\":' || coalesce(page_count::varchar, 'null') || '}' as json from r",
}
