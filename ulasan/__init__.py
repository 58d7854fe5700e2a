"""ulasan: Spark-native engine for social-media text corpora and sentiment
models. The names below are the public API; every function takes and returns
lazy DataFrames or Columns (jobs return small dicts of counts)."""
from .functions.dates import day_param, day_range, parse_utc
from .functions.text import clean_and_filter, clean_text, html_unescape, tokens, uni_bigrams
from .operators.collect import (cap_newest, collection_rollup as collection_report, first_keyword,
                                greedy_collect as collect_capped, keyword_day_grid, match_keywords, search_posts)
from .operators.counts import value_counts, with_share, word_frequencies
from .operators.counts import zero_filled_counts as label_counts
from .operators.dedupe import keep_first as dedupe_keep_first, nulls_first, order_key
from .operators.labelling import (assign_batches, batch_rows, build_prompts, label_job, parse_response,
                                  parse_responses, pending_rows, pending_slots, pending_texts, publish as publish_labels,
                                  restore_labels, run_labeller as label_batches, symbol_of, with_label_column)
from .operators.positions import with_positions
from .operators.review import override_labels, sample_exact
from .operators.split import class_weights, split_sizes, stratified_kfold, stratified_split
from .plans.corpus import build_corpus, clean_corpus, merge_sources, sort_corpus
from .plans.evaluate import classification_report, confusion_matrix, macro_f1
from .plans.svm import OvoModel, grid_search, linear_scores, ovo_vote, train_classifier
from .plans.tfidf import fit_transform as fit_tfidf, fit_vocab, transform as transform_tfidf
from .sources.files import read_csv, write_csv
from .sources.registry import SourceSpec, count_or_zero, scan_sources
from .streaming.epochs import read_epochs, write_epoch
from .streaming.jobs import (daily_counts as stream_daily_counts, dedupe_ingest as stream_ingest_dedupe,
                             dedupe_within_watermark, read_daily, read_ingested, read_scored, score_stream as stream_predict)


def make_batches(rows, state, size: int = 35):
    """M04 batching: positions on ``row_id``, batches of ``size`` cut on the
    full positions, rows already in ``state`` removed, one row per batch."""
    from pyspark.sql import functions as F
    return batch_rows(pending_texts(rows, state, [F.col("row_id")], size))


def save_model(model: OvoModel, path: str) -> None:
    model.save(path)


def load_model(spark, path: str) -> OvoModel:
    return OvoModel.load(spark, path)


def predict(model: OvoModel, docs, id_col: str = "row_id", text_col: str = "text", clean: bool = False):
    return model.predict(docs, id_col, text_col, clean)
