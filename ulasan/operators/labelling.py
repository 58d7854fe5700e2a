"""Batch labelling.

Rows are cut into batches of ``size`` on their full positions, already
labelled rows are removed (left-anti join with the label state), each batch
becomes one prompt row, a pluggable labeller runs in executor Python workers
(``mapInPandas``), and its raw responses are parsed natively. Labels are
appended to a state table keyed by ``row_id``; re-runs skip what is there.
"""
from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import WS
from ..functions.text import let, strip_ws
from .positions import with_positions

# --- fixed values: label domain and prompt texts of the labeller -------------
LABELS = ["negatif", "netral", "positif"]          # class order (alphabetical)
REPORT_ORDER = ["positif", "negatif", "netral"]    # order of the summary counts
DEFAULT_LABEL = "netral"
SYMBOLS = {"positif": "+", "negatif": "-", "netral": "~"}   # scorer output symbols
UNKNOWN_SYMBOL = "?"
BATCH_SIZE = 35
SYSTEM_PROMPT = (
    "Kamu adalah annotator sentimen untuk teks media sosial berbahasa Indonesia. "
    "Tugasmu mengklasifikasikan setiap teks terkait program "
    '"Makan Bergizi Gratis (MBG)" menjadi salah satu dari tiga label:\n\n'
    '- "positif" — teks mendukung, memuji, optimis, atau menyetujui MBG.\n'
    '- "negatif" — teks mengkritik, menolak, mengecam, atau kecewa terhadap MBG.\n'
    '- "netral"  — teks informatif, faktual, tidak berpihak, atau tidak mengandung sentimen jelas.\n\n'
    "Perhatikan:\n"
    "- Jika teks tidak terkait MBG sama sekali, tetap beri label 'netral'.\n"
    "- Jika ada sarkasme, pilih sentimen yang SESUNGGUHNYA dimaksud (bukan literal).\n"
    "- Jangan tambahkan teks apapun selain JSON."
)
PROMPT_HEAD = "Klasifikasikan {count} teks di bawah ini.\n\n"
PROMPT_TAIL = ("\n\nBalas HANYA dengan JSON array persis seperti format ini, "
               "tanpa teks pembuka atau penutup:\n"
               '[{"index": 0, "label": "positif"}, {"index": 1, "label": "negatif"}, ...]')
FENCE = "```"
# ---------------------------------------------------------------------------

STATE_SCHEMA = "row_id long, label string, batch_id long, labelled_at timestamp"


def symbol_of(label: Column) -> Column:
    """The label's symbol, by a literal map with a default."""
    m = F.create_map(*[F.lit(x) for kv in SYMBOLS.items() for x in kv])
    return F.coalesce(m[label], F.lit(UNKNOWN_SYMBOL))


# --- batching and prompts ---------------------------------------------------------
def assign_batches(rows: DataFrame, order: list[Column], size: int = BATCH_SIZE) -> DataFrame:
    """E02 + D17: position every row on the total ``order`` and cut batches of
    ``size`` on the full positions (before pending rows are filtered)."""
    d = with_positions(rows, order, "pos")
    return d.withColumn("batch_id", F.floor(F.col("pos") / size).cast("long"))


def pending_slots(rows: DataFrame, state: DataFrame | None, order: list[Column], size: int = BATCH_SIZE) -> DataFrame:
    """``(row_id, pos, batch_id)`` of the rows without a label in the state, on
    their full positions. Texts take no part in the range shuffle."""
    slots = with_positions(rows, order, "pos", keep=["row_id"])
    return pending_rows(slots.withColumn("batch_id", F.floor(F.col("pos") / size).cast("long")), state)


def pending_texts(rows: DataFrame, state: DataFrame | None, order: list[Column], size: int = BATCH_SIZE) -> DataFrame:
    """The pending slots with their rows' other columns, fetched by ``row_id``, the
    key of the rows and of the state (unique, not NULL)."""
    return rows.join(pending_slots(rows, state, order, size), "row_id")


def pending_rows(rows: DataFrame, state: DataFrame | None) -> DataFrame:
    """Rows whose ``row_id`` has no label in the state (a NULL label
    is none)."""
    if state is None:
        return rows
    done = state.where("label IS NOT NULL") if "label" in state.columns else state
    return rows.join(done.select("row_id"), "row_id", "left_anti")


def latest_labels(state: DataFrame) -> DataFrame:
    """``(row_id, label)`` of an append-only state: the newest label of each
    row that is not NULL, so that overlapping runs count once."""
    when = F.col("labelled_at") if "labelled_at" in state.columns else F.lit(0)
    return (state.where("label IS NOT NULL").groupBy("row_id")
            .agg(F.max(F.struct(when.alias("at"), "label"))["label"].alias("label")))


def with_label_column(rows: DataFrame, name: str = "label") -> DataFrame:
    """``rows`` with a label column, NULL where there was none."""
    return rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast("string"))


def restore_labels(rows: DataFrame, state: DataFrame | None) -> DataFrame:
    """``rows`` with the labels that earlier runs left in the state (its newest
    of each row that is not NULL); other rows keep their own label or none. Rows
    are matched by ``row_id``, so the state may hold more rows, or fewer."""
    rows = with_label_column(rows)
    if state is None or "label" not in state.columns:
        return rows
    earlier = latest_labels(state).withColumnRenamed("label", "__earlier")
    return (rows.join(earlier, "row_id", "left").withColumn("label", F.coalesce("__earlier", "label"))
            .select(*rows.columns))


def batch_rows(positioned: DataFrame, text: str = "text") -> DataFrame:
    """One row per batch that still has pending rows: ``(batch_id, n, row_ids,
    texts)``, items in position order; a batch holds at most ``size`` rows."""
    g = positioned.groupBy("batch_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "row_id", F.col(text).alias("text")))).alias("items"))
    return g.select("batch_id", F.size("items").cast("int").alias("n"),
                    F.col("items.row_id").alias("row_ids"), F.col("items.text").alias("texts"))


def prompt_text(texts: Column) -> Column:
    """Numbered lines ``[i] text`` (i restarts at 0 in every batch)
    inside the user prompt template."""
    lines = F.array_join(F.transform(texts, lambda t, i: F.concat(
        F.lit("["), i.cast("string"), F.lit("] "), F.coalesce(t, F.lit("")))), "\n")
    head = F.replace(F.lit(PROMPT_HEAD), F.lit("{count}"), F.size(texts).cast("string"))
    return F.concat(head, lines, F.lit(PROMPT_TAIL))


def build_prompts(batches: DataFrame) -> DataFrame:
    return batches.withColumn("system", F.lit(SYSTEM_PROMPT)).withColumn("prompt", prompt_text(F.col("texts")))


# --- response parsing ---------------------------------------------------------------
def _try_parse_json(x: Column) -> Column:
    return F.call_function("try_parse_json", x)


def _schema(v: Column) -> Column:
    return F.call_function("schema_of_variant", v)


def _names_may_repeat(df: DataFrame) -> None:
    """Spark's own setting by which the last of repeated names counts."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


# a JSON string, or one of the number words that ``json.loads`` takes
_STRING_OR_WORD = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|(?<![\w.+-])(?:NaN|-?Infinity)(?![\w.])'


def _plain_json(x: Column) -> Column:
    """The text with NaN, Infinity and -Infinity outside strings put as 1.5: like
    them no integer, no text and no object. Strings are scanned with their escapes,
    so that words inside them stay."""
    hits = F.regexp_extract_all(x, F.lit(f"(?s){_STRING_OR_WORD}"), F.lit(0))
    scanned = let(hits, lambda h: F.array_join(F.flatten(F.transform(
        F.split(x, f"(?s){_STRING_OR_WORD}", -1), lambda gap, i: F.array(gap, F.when(
            F.get(h, i).startswith('"'), F.get(h, i)).otherwise(F.when(F.get(h, i).isNotNull(), F.lit("1.5")).otherwise(F.lit("")))))), ""))
    return F.when(x.rlike("NaN|Infinity"), scanned).otherwise(x)


def _strict(x: Column) -> Column:
    return (_try_parse_json(F.concat(F.lit('{"a":'), x, F.lit("}"))).isNotNull()
            & _try_parse_json(F.concat(F.lit("["), x, F.lit("]"))).isNotNull())


def unfence(raw: Column) -> Column:
    """Strip; if it starts with a fence, drop every line starting with
    one and strip again."""
    s = strip_ws(raw)
    body = F.array_join(F.filter(F.split(s, "\n", -1), lambda ln: ~ln.startswith(F.lit(FENCE))), "\n")
    return F.when(s.startswith(F.lit(FENCE)), strip_ws(body)).otherwise(s)


def _item(v: Column) -> Column:
    """One parsed array element → ``struct(idx, label, bad)``; ``bad`` marks
    shapes the reference fails on (non-object item, non-string or null
    label), which make the whole batch a retry."""
    sch = _schema(v)
    lab = F.call_function("variant_get", v, F.lit("$.label"))
    idx = F.call_function("variant_get", v, F.lit("$.index"))
    is_obj = sch.startswith("OBJECT")
    lab_ok = lab.isNull() | (_schema(lab) == "STRING")
    idx_int = _schema(idx).isin("BIGINT", "INT", "SMALLINT", "TINYINT")
    label = F.coalesce(F.call_function("variant_get", v, F.lit("$.label"), F.lit("string")), F.lit(DEFAULT_LABEL))
    label = F.lower(strip_ws(label))
    label = F.when(label.isin(LABELS), label).otherwise(F.lit(DEFAULT_LABEL))
    index = (F.when(is_obj & idx_int, F.call_function("variant_get", v, F.lit("$.index"), F.lit("long")))
              .when(is_obj & (_schema(idx) == "BOOLEAN"),          # a bool is an int there
                    F.call_function("variant_get", v, F.lit("$.index"), F.lit("boolean")).cast("long")))
    return F.struct(index.alias("idx"), label.alias("label"), (~(is_obj & lab_ok)).alias("bad"))


def parse_response(raw: Column, n: Column) -> Column:
    """M05/K04 as one expression: ``struct(status, labels array<string>)``.

    status: ``ok`` (labels by index, last write wins, ``netral`` elsewhere),
    ``fallback_netral`` (no parseable array: all ``netral``), ``retry`` (valid
    JSON of the wrong shape, or no response at all; labels NULL).

    A strictly valid array equals its own first-'['-to-last-']' extract, so
    parsing the extract covers both the direct and the regex path. NaN and the
    infinities are numbers, an empty object holds no items, and ``true`` is the
    index 1, as in ``json.loads``; so is the last of repeated names, if the session
    sets ``spark.sql.variant.allowDuplicateKeys`` (the functions on DataFrames below
    do)."""
    def result(status: str, labels: Column, n_items: Column = F.lit(None)) -> Column:
        return F.struct(F.lit(status).alias("status"), labels.cast("array<string>").alias("labels"),
                        n_items.cast("int").alias("n_items"))

    def by_index(items: Column) -> Column:
        return F.transform(F.slice(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), 1, n), lambda p: F.coalesce(
            F.try_element_at(F.filter(items, lambda it: it["idx"] == p), F.lit(-1))["label"], F.lit(DEFAULT_LABEL)))

    def with_items(s: Column, arr: Column, items: Column) -> Column:
        all_netral = F.array_repeat(F.lit(DEFAULT_LABEL), n)
        not_array = _strict(s) & ~s.startswith("[")
        return (F.when(not_array & s.rlike(r'^(""|\{[ \t\n\r]*\})$'), result("ok", all_netral))     # nothing to go through
                 .when(not_array, result("retry", F.lit(None)))
                 .when(arr.isNull(), result("fallback_netral", all_netral))
                 .when(F.exists(items, lambda it: it["bad"]), result("retry", F.lit(None), F.size(items)))
                 .otherwise(result("ok", by_index(items), F.size(items))))

    def with_array(s: Column, arr: Column) -> Column:
        return let(F.transform(arr, _item), lambda items: with_items(s, arr, items))

    def with_extract(s: Column, e: Column) -> Column:
        s, e = _plain_json(s), _plain_json(e)
        return let(s, lambda s: let(e, lambda e: with_plain(s, e)))

    def with_plain(s: Column, e: Column) -> Column:
        arr = F.when(_strict(e), F.call_function("variant_get", _try_parse_json(e), F.lit("$"),
                                                 F.lit("array<variant>")))
        return let(arr, lambda a: with_array(s, a))

    parsed = let(unfence(raw), lambda s: let(F.regexp_extract(s, r"(?s)\[.*\]", 0),
                                             lambda e: with_extract(s, e)))
    return F.when(raw.isNull(), result("retry", F.lit(None))).otherwise(parsed)


def parse_responses(responses: DataFrame) -> DataFrame:
    """``(batch_id, n, raw)`` → ``(batch_id, pos, label, status)``; retry
    batches give one row per position with a NULL label."""
    _names_may_repeat(responses)
    p = responses.select("batch_id", "n", parse_response(F.col("raw"), F.col("n")).alias("r"))
    return p.select("batch_id", F.col("r.status").alias("status"),
                    F.posexplode(F.coalesce(F.col("r.labels"),
                                            F.array_repeat(F.lit(None).cast("string"), F.col("n")))).alias("pos", "label"))


# --- the labeller hook and state --------------------------------------------------------
def run_labeller(prompts: DataFrame, labeller: Callable[[list[dict], list[list[str]]], list[str]]) -> DataFrame:
    """Call ``labeller(messages, texts)`` → raw responses inside executor
    Python workers, one Arrow batch of prompt rows at a time; each message has
    the ``system`` and the ``user`` prompt. A call that raises is repeated prompt
    by prompt; a prompt that raises alone gets a NULL response (status ``retry``)
    and stays pending."""
    def answers(messages: list[dict], texts: list[list[str]]) -> list[str | None]:
        try:
            return list(labeller(messages, texts))
        except Exception:
            if len(messages) == 1:
                return [None]
            return [answers([m], [t])[0] for m, t in zip(messages, texts)]

    def fn(it):
        for pdf in it:
            messages = [{"system": s, "user": u} for s, u in zip(pdf["system"], pdf["prompt"])]
            raws = answers(messages, [list(t) for t in pdf["texts"]])
            yield pd.DataFrame({"batch_id": pdf["batch_id"], "n": pdf["n"], "row_ids": pdf["row_ids"],
                                "raw": raws})
    return prompts.select("batch_id", "n", "row_ids", "system", "prompt", "texts").mapInPandas(
        fn, "batch_id long, n int, row_ids array<long>, raw string")


def labels_from_responses(responses: DataFrame) -> DataFrame:
    """Label k of a batch belongs to its k-th pending row; retry batches
    produce nothing (they stay pending)."""
    _names_may_repeat(responses)
    p = responses.select("batch_id", "row_ids", parse_response(F.col("raw"), F.col("n")).alias("r"))
    ok = p.filter(F.col("r.status") != "retry")
    z = ok.select("batch_id", F.explode(F.arrays_zip(F.col("row_ids").alias("row_id"),
                                                     F.col("r.labels").alias("label"))).alias("z"))
    return z.select(F.col("z.row_id").alias("row_id"), F.col("z.label").alias("label"), "batch_id",
                    F.current_timestamp().alias("labelled_at"))


def publish(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Every row with its label; rows without one show ``netral`` (only
    in this published view, the state keeps them unlabelled)."""
    return rows.join(latest_labels(state), "row_id", "left").withColumn("label", F.coalesce("label", F.lit(DEFAULT_LABEL)))


#: Batches of a task, and tasks of a commit.
TASK_BATCHES, COMMIT_TASKS = 20, 64


def label_job(rows: DataFrame, state_path: str, labeller, order: list[Column] | None = None,
              size: int = BATCH_SIZE, task_batches: int = TASK_BATCHES, commit_tasks: int = COMMIT_TASKS) -> dict:
    """M04/J04 as a resumable job: rows without a label in the state table are
    batched (on their full positions), prompted, labelled, parsed and appended
    to the state. Returns counts; does nothing when no row is pending (B17).

    The prompts are written as files of ``task_batches`` batches and streamed,
    ``commit_tasks`` files at a time: the labels of each group are committed
    before the next group is asked for, so a job that dies keeps them, and
    another run labels only what is still missing."""
    from ..session import scratch_path
    from ..sources.registry import read_table
    spark = rows.sparkSession
    state = read_table(spark, state_path, "parquet")
    pending = pending_rows(rows, state)
    if pending.isEmpty():
        return {"pending": 0, "labelled": 0}
    prompts = build_prompts(batch_rows(pending_texts(rows, state, order or [F.col("row_id")], size)))
    source = scratch_path(spark, "prompts")
    # by batch number, so that files hold their batches in order and of about one size
    (prompts.repartition(commit_tasks, F.floor(F.col("batch_id") / task_batches)).sortWithinPartitions("batch_id")
     .write.option("maxRecordsPerFile", task_batches).parquet(source))
    written = spark.read.parquet(source)
    todo = written.agg(F.sum("n")).first()[0] or 0

    def label(group: DataFrame, epoch: int) -> None:
        labels_from_responses(run_labeller(group, labeller)).write.mode("append").parquet(state_path)

    stream = spark.readStream.schema(written.schema).option("maxFilesPerTrigger", commit_tasks).parquet(source)
    (stream.writeStream.foreachBatch(label).option("checkpointLocation", scratch_path(spark, "label_commits"))
     .trigger(availableNow=True).start().awaitTermination())
    done = read_table(spark, state_path, "parquet", schema=STATE_SCHEMA)
    return {"pending": int(todo), "labelled": done.select("row_id").distinct().count() if done is not None else 0}
