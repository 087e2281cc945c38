"""Query catalogue: ``name -> fn(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (mostly the syslog view rendered from
``events``) and runs over whole tables.  Parameters are fixed here so that the
oracle SQL in :mod:`logweave.plans.oracle` computes the same thing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as TK
from ..operators import evaluation as EV
from ..operators import features as FT
from ..operators import files as FL
from ..operators import labels as LB
from ..operators import logsig as LS
from ..operators import models as MD
from ..operators import sentences as SN
from ..operators import similarity as SM
from ..operators import templates as TP
from ..operators import windows as WN
from ..operators.numbering import number_rows, number_within
from ..session import scratch_path, written
from ..sources import tables, text

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}

# Fixed parameters for the events log view (gaps average 4.3 minutes).
W_SIZE = 1800          # time-window width, seconds
W_STEP = 600           # time-window step, seconds
COUNT_W = 5            # count-window size, lines
TARGET = " error "     # target error: masked template contains the program "error"
OOV_TOP = 10           # dictionary of the 10 most frequent templates for the OOV report
CAL_UNIT = "hour"      # calendar windows: hours, 3 per window, restarting each day
CAL_W = 3


def query(fn: QueryFn) -> QueryFn:
    QUERIES[fn.__name__] = fn
    return fn


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events_log(spark, sf_dir)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TP.parse_log(log_lines(spark, sf_dir))


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TP.mask_templates(parsed(spark, sf_dir))


# ---- milestone 1: parse, mask, count -------------------------------------------------

@query
def parse_log(spark, sf_dir):
    return parsed(spark, sf_dir)


@query
def mask_templates(spark, sf_dir):
    return masked(spark, sf_dir).select("line_id", "t", "host", "program", "template")


@query
def line_count(spark, sf_dir):
    return TP.line_count(log_lines(spark, sf_dir))


@query
def template_counts(spark, sf_dir):
    return TP.template_counts(masked(spark, sf_dir))


@query
def template_counts_by_program(spark, sf_dir):
    return TP.template_counts(masked(spark, sf_dir), ("program",))


@query
def template_counts_by_host(spark, sf_dir):
    return TP.template_counts_by_host(masked(spark, sf_dir))


def seconds(spark, sf_dir) -> DataFrame:
    """Per-second template counts: the shared input of windows, targets and the
    dictionary, materialized once so the log is parsed once per query."""
    return written(WN.per_second(masked(spark, sf_dir)), "seconds")


def with_idx(sec: DataFrame, d: DataFrame) -> DataFrame:
    """Per-second counts with the dictionary number beside the template, joined once:
    everything after it carries the number."""
    return written(FT.with_index(sec, d), "indexed")


def indexed(spark, sf_dir) -> DataFrame:
    sec = seconds(spark, sf_dir)
    return with_idx(sec, dictionary_of(sec))


def dictionary_of(sec: DataFrame) -> DataFrame:
    """W7 dictionary from per-second counts."""
    return TP.template_dictionary(TP.totals(sec))


def dictionary(spark, sf_dir) -> DataFrame:
    return dictionary_of(seconds(spark, sf_dir))


@query
def template_dictionary(spark, sf_dir):
    return dictionary(spark, sf_dir)


@query
def one_hot_dictionary(spark, sf_dir):
    return TP.one_hot_dictionary(dictionary(spark, sf_dir))


@query
def oov_templates(spark, sf_dir):
    m = masked(spark, sf_dir)
    top = TP.top_templates(TP.template_counts(m), OOV_TOP)
    return TP.oov_templates(m, top)


# ---- milestone 2: numbering, windows, features, labels -------------------------------
# Each query builds the per-second counts once and passes them to every branch.

@query
def line_numbers(spark, sf_dir):
    # masked after the numbering: the range exchange looks at its input twice
    numbered = number_rows(parsed(spark, sf_dir).select("line_id", "line"), ["line_id"], name="line_no")
    return TP.mask_templates(numbered).drop("line")


@query
def time_sorted_log(spark, sf_dir):
    numbered = number_rows(parsed(spark, sf_dir).select("t", "line_id", "line"), ["t", "line_id"], name="rank")
    return TP.mask_templates(numbered).drop("line")


@query
def count_windows_fixed(spark, sf_dir):
    return WN.count_window_contents(masked(spark, sf_dir), COUNT_W, "fixed")


@query
def count_windows_sliding(spark, sf_dir):
    return WN.count_window_contents(masked(spark, sf_dir), COUNT_W, "sliding", mode="reference")


def main_windows_of(sec: DataFrame) -> DataFrame:
    return WN.time_window_contents(sec, W_SIZE, W_STEP)


def target_contents_of(sec: DataFrame) -> DataFrame:
    return WN.target_window_contents(sec, TARGET, W_SIZE)


@query
def time_windows(spark, sf_dir):
    return main_windows_of(seconds(spark, sf_dir))


@query
def calendar_windows(spark, sf_dir):
    return WN.calendar_window_contents(masked(spark, sf_dir), CAL_UNIT, CAL_W)


@query
def target_events(spark, sf_dir):
    return LB.target_events(masked(spark, sf_dir), TARGET).select("line_id", "t", "template")


@query
def target_windows(spark, sf_dir):
    return target_contents_of(seconds(spark, sf_dir))


@query
def count_windows_sliding_full(spark, sf_dir):
    return WN.count_window_contents(masked(spark, sf_dir), COUNT_W, "sliding", mode="full")


@query
def target_windows_open(spark, sf_dir):
    return WN.target_window_contents(seconds(spark, sf_dir), TARGET, W_SIZE, include_target=False)


@query
def template_counts_ranked(spark, sf_dir):
    return TP.ranked_counts(TP.template_counts(masked(spark, sf_dir)))


@query
def windows_in_order(spark, sf_dir):
    # O3: count windows by code, templates by name, with their place in that order
    contents = WN.count_window_contents(masked(spark, sf_dir), COUNT_W, "fixed")
    return number_rows(contents, ["win", "template"], name="place")


def main_frequencies(si: DataFrame) -> DataFrame:
    return FT.window_frequencies(WN.time_window_contents(si, W_SIZE, W_STEP, "idx"), ["win", "ws", "we"])


@query
def window_frequencies(spark, sf_dir):
    sec = seconds(spark, sf_dir)
    d = dictionary_of(sec)
    freqs = main_frequencies(with_idx(sec, d))
    return freqs.join(d, "idx").select("win", "ws", "we", "idx", "template", "cnt", "freq")


@query
def calendar_window_frequencies(spark, sf_dir):
    contents = WN.calendar_window_contents(masked(spark, sf_dir), CAL_UNIT, CAL_W)
    return FT.window_frequencies(contents, ["wkey", "code"])


@query
def window_mean_vector(spark, sf_dir):
    contents = WN.time_window_contents(indexed(spark, sf_dir), W_SIZE, W_STEP, "idx")
    vectors = FT.vector_dictionary(tables.table(spark, sf_dir, "embeddings"))
    return FT.window_mean_vector(contents, ["win", "ws", "we"], vectors)


@query
def missing_vectors(spark, sf_dir):
    # J4 report of the mean vectors: templates without a vector
    vectors = FT.vector_dictionary(tables.table(spark, sf_dir, "embeddings"))
    return FT.missing_vectors(indexed(spark, sf_dir), vectors)


@query
def labeled_windows(spark, sf_dir):
    sec = seconds(spark, sf_dir)
    return LB.labeled_windows(main_windows_of(sec), sec, TARGET, W_SIZE)


@query
def labeled_windows_horizon(spark, sf_dir):
    sec = seconds(spark, sf_dir)
    return LB.labeled_windows(main_windows_of(sec), sec, TARGET, W_SIZE, mode="horizon", horizon=W_STEP)


def training_of(si: DataFrame) -> DataFrame:
    """U1 from indexed per-second counts."""
    main = LB.labelled_frequencies(main_frequencies(si), si, TARGET, W_SIZE)
    tgt = FT.window_frequencies(WN.target_window_contents(si, TARGET, W_SIZE, key="idx"), ["ws", "we"])
    return LB.training_set(main, tgt)


@query
def training_set(spark, sf_dir):
    return training_of(indexed(spark, sf_dir))


# ---- count windows: features and labels ------------------------------------------------

def _both_kinds(of_kind) -> DataFrame:
    one, two = (of_kind(kind).withColumn("kind", F.lit(kind)) for kind in ("fixed", "sliding"))
    return one.unionByName(two)


@query
def count_window_labels(spark, sf_dir):
    m = masked(spark, sf_dir)
    return _both_kinds(lambda kind: LB.labeled_count_windows(
        WN.count_window_contents(m, COUNT_W, kind), m, TARGET, COUNT_W, kind))


@query
def count_window_vectors(spark, sf_dir):
    # lines get their dictionary number before any window is formed
    m = written(masked(spark, sf_dir).select("line_id", "template"), "masked")
    lines = written(FT.with_index(m, dictionary_of(WN.template_totals(m))).select("line_id", "idx"), "lines")
    vectors = FT.vector_dictionary(tables.table(spark, sf_dir, "embeddings"))
    return _both_kinds(lambda kind: FT.window_mean_vector(
        WN.count_window_contents(lines, COUNT_W, kind, key="idx"), ["win"], vectors))


# ---- calendar windows: labels and mean vectors -------------------------------------------


@query
def calendar_window_labels(spark, sf_dir):
    m = masked(spark, sf_dir)
    return LB.labeled_calendar_windows(WN.calendar_window_contents(m, CAL_UNIT, CAL_W), m, TARGET, CAL_UNIT, CAL_W)


@query
def calendar_window_vectors(spark, sf_dir):
    contents = FT.with_index(WN.calendar_window_contents(masked(spark, sf_dir), CAL_UNIT, CAL_W), dictionary(spark, sf_dir))
    return FT.window_mean_vector(contents, ["wkey", "code"], FT.vector_dictionary(tables.table(spark, sf_dir, "embeddings")))


# ---- count windows within each controller ------------------------------------------------
# Every controller's log is numbered on its own; windows never hold lines of two controllers.

HOST = ("host",)


def numbered_by_host(spark, sf_dir) -> DataFrame:
    """Every controller's lines numbered from 1: ``(host, x, template)``."""
    # masked and written before the numbering, which looks at its input twice
    m = written(masked(spark, sf_dir).select("host", "line_id", "template"), "masked")
    return written(number_within(m, ["host"], ["line_id"], name="x").select("host", "x", "template"), "by_host")


def host_windows(by_host: DataFrame, kind: str, key: str = "template") -> DataFrame:
    return WN.count_window_contents(by_host, COUNT_W, kind, x="x", keys=HOST, key=key)


@query
def host_window_labels(spark, sf_dir):
    by_host = numbered_by_host(spark, sf_dir)
    return _both_kinds(lambda kind: LB.labeled_count_windows(host_windows(by_host, kind), by_host, TARGET, COUNT_W, kind, "x", HOST))


@query
def host_window_vectors(spark, sf_dir):
    by_host = numbered_by_host(spark, sf_dir)
    d = dictionary_of(WN.template_totals(by_host))
    vectors = FT.vector_dictionary(tables.table(spark, sf_dir, "embeddings"))
    lines = written(FT.with_index(by_host, d).select("host", "x", "idx"), "lines")
    return _both_kinds(lambda kind: FT.window_mean_vector(host_windows(lines, kind, "idx"), ["host", "win"], vectors))


# ---- milestone 3: metrics and models -------------------------------------------------

TEST_HOSTS = "c0-0c1s"    # held-out evaluation: train on all other controller groups, with their dictionary


@query
def confusion_matrix(spark, sf_dir):
    labels = tables.table(spark, sf_dir, "labels")
    return EV.confusion_matrix(labels, label="quality", prediction="toxic")


def vectors_of(long: DataFrame, d: DataFrame) -> DataFrame:
    size = d.select(F.count(F.lit(1))).scalar()
    return MD.labelled_vectors(long, size)


def all_vectors(spark, sf_dir) -> DataFrame:
    sec = seconds(spark, sf_dir)
    d = dictionary_of(sec)
    return vectors_of(training_of(with_idx(sec, d)), d)


@query
def svm_metrics(spark, sf_dir):
    return MD.fit_and_evaluate(MD.linear_svm(100), all_vectors(spark, sf_dir))[1]


@query
def logreg_metrics(spark, sf_dir):
    return MD.fit_and_evaluate(MD.logistic_regression(), all_vectors(spark, sf_dir))[1]


def side_of(host: str = "host"):
    return F.when(F.col(host).startswith(TEST_HOSTS), F.lit("test")).otherwise(F.lit("train"))


def by_sides(spark, sf_dir) -> DataFrame:
    """Per-second counts by side, from one pass over the log."""
    return written(masked(spark, sf_dir).groupBy(side_of().alias("side"), "t", "template")
                   .agg(F.count(F.lit(1)).alias("cnt")), "sides")


def train_dictionary(by_side: DataFrame) -> DataFrame:
    """W7 dictionary of the training side alone; the test side's other templates follow the OOV policy (skip)."""
    return dictionary_of(by_side.where("side = 'train'"))


def held_out(spark, sf_dir):
    """Training rows of all host groups but one, main windows of that one, and the training side's dictionary."""
    by_side = by_sides(spark, sf_dir)
    d = train_dictionary(by_side)
    train, test = (with_idx(by_side.where(F.col("side") == s).drop("side"), d) for s in ("train", "test"))
    return training_of(train), training_of(test).where(F.col("kind") == "main"), d


@query
def tree_metrics(spark, sf_dir):
    train, test, d = held_out(spark, sf_dir)
    return MD.fit_and_evaluate(MD.decision_tree(5, 32), vectors_of(train, d), vectors_of(test, d))[1]


@query
def tree_text(spark, sf_dir):
    # The fitted tree as text lines
    train, test, d = held_out(spark, sf_dir)
    model, _ = MD.fit_and_evaluate(MD.decision_tree(5, 32), vectors_of(train, d), vectors_of(test, d))
    return spark.createDataFrame(list(enumerate(MD.tree_description(model).rstrip().split("\n"))), "line_no int, line string")


@query
def model_label_totals(spark, sf_dir):
    windows = ["kind", "ws", "we", "label"]
    everything = training_of(indexed(spark, sf_dir)).select(*windows).distinct()
    test = held_out(spark, sf_dir)[1].select(*windows).distinct()
    return (EV.label_totals(everything, "svm").unionByName(EV.label_totals(everything, "logreg"))
            .unionByName(EV.label_totals(test, "tree")))


@query
def count_window_metrics(spark, sf_dir):
    # fixed count windows: template frequencies -> logistic regression
    m = masked(spark, sf_dir)
    d = dictionary(spark, sf_dir)
    contents = WN.count_window_contents(m, COUNT_W, "fixed")
    freqs = FT.window_frequencies(contents, ["win"], d)
    lab = LB.labeled_count_windows(contents, m, TARGET, COUNT_W, "fixed")
    size = d.select(F.count(F.lit(1))).scalar()
    vectors = MD.labelled_vectors(freqs.join(lab, "win"), size, ("win", "label"))
    return MD.fit_and_evaluate(MD.logistic_regression(), vectors)[1]


@query
def held_out_coverage(spark, sf_dir):
    # how much of either side the training side's dictionary knows
    by_side = by_sides(spark, sf_dir)
    return FT.coverage(by_side, train_dictionary(by_side), ("side",))


@query
def host_window_metrics(spark, sf_dir):
    # count windows within each controller, fixed and sliding -> SVM and logistic regression,
    # trained with the dictionary of all controllers but a group, tested on that group
    by_host = numbered_by_host(spark, sf_dir).withColumn("side", side_of())
    d = written(dictionary_of(WN.template_totals(by_host.where("side = 'train'"))), "dictionary")
    size = d.count()
    out = None
    for kind in ("fixed", "sliding"):
        contents = host_windows(by_host, kind)
        freqs = FT.window_frequencies(contents, ["host", "win"], d)
        lab = LB.labeled_count_windows(contents, by_host, TARGET, COUNT_W, kind, "x", HOST)
        vectors = MD.labelled_vectors(freqs.join(lab, ["host", "win"]), size, ("host", "win", "label")).withColumn("side", side_of())
        train, test = (vectors.where(F.col("side") == side) for side in ("train", "test"))
        for name, model in (("svm", MD.linear_svm(100)), ("logreg", MD.logistic_regression())):
            row = MD.fit_and_evaluate(model, train, test)[1].select(F.lit(kind).alias("kind"), F.lit(name).alias("model"), "*")
            out = row if out is None else out.unionByName(row)
    return out


def sentences_of(spark, sf_dir) -> DataFrame:
    return MD.sentences(masked(spark, sf_dir))


@query
def word2vec_sentences(spark, sf_dir):
    return sentences_of(spark, sf_dir).select("host", "piece", F.size("sentence").alias("n"))


def word2vec_model(spark, sf_dir):
    return MD.fit_word2vec(sentences_of(spark, sf_dir))


@query
def template_embeddings(spark, sf_dir):
    return MD.embedding_table(word2vec_model(spark, sf_dir))


@query
def template_embedding_sizes(spark, sf_dir):
    return template_embeddings(spark, sf_dir).select("word", F.size("vector").alias("size"))


@query
def embedding_window_metrics(spark, sf_dir):
    # trained template vectors -> mean of each time window -> logistic regression
    sec = seconds(spark, sf_dir)
    d = dictionary_of(sec)
    si = with_idx(sec, d)
    vectors = (template_embeddings(spark, sf_dir).join(d, F.col("word") == F.col("template"))
               .select("idx", F.col("vector").cast("array<double>").alias("vec")))
    contents = WN.time_window_contents(si, W_SIZE, W_STEP, "idx")
    keys = ["win", "ws", "we"]
    means = MD.mean_vectors(FT.window_mean_vector(contents, keys, vectors, digits=None, long=False), keys)
    train = written(LB.labelled_frequencies(means, si, TARGET, W_SIZE), "train")
    return MD.fit_and_evaluate(MD.logistic_regression(), train)[1]


@query
def template_synonyms(spark, sf_dir):
    # M3: the templates nearest to the most frequent error, searched in the exported vectors by a plan
    m = masked(spark, sf_dir)
    top_error = (TP.template_counts(LB.target_events(m, TARGET))
                 .orderBy(F.col("cnt").desc(), "template").select("template").first()[0])
    vectors = written(template_embeddings(spark, sf_dir), "vectors")
    return SM.similar_vectors(vectors, top_error, 5, key="word", vector="vector")


@query
def template_neighbours(spark, sf_dir):
    # M3 for every template: its five nearest others
    vectors = written(template_embeddings(spark, sf_dir), "vectors")
    return SM.nearest_vectors(vectors, 5, key="word", vector="vector")


@query
def nearest_vectors(spark, sf_dir):
    return SM.nearest_vectors(tables.table(spark, sf_dir, "embeddings"), 5)


@query
def similar_vectors(spark, sf_dir):
    return SM.similar_vectors(tables.table(spark, sf_dir, "embeddings"), 0, 5)


# ---- milestone 4: files and sentences ------------------------------------------------



LIST_RULE = "length(event_type) > 4"   # the program list names these, and leaves the others out
FILE_ROWS = 200                         # rows per file of the compacted log


def program_list(spark, sf_dir) -> DataFrame:
    """S3: the program list, written as a text file of names and read back."""
    path = scratch_path(spark, "programs")
    names = tables.table(spark, sf_dir, "events").where(LIST_RULE).select(F.concat("event_type", F.lit("  ")).alias("value"))
    names.distinct().write.text(path)
    return text.read_program_list(spark, path)


@query
def read_text_log(spark, sf_dir):
    # The rendered log written as text files in line order, read back by glob and numbered
    path = scratch_path(spark, "log")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = log_lines(spark, sf_dir)
    lines.repartitionByRange(n, "line_id").sortWithinPartitions("line_id").select("line").write.text(path)
    read = TP.parse_log(text.read_log_text(spark, path + "/part-*"))
    return read.join(program_list(spark, sf_dir), "program", "left_semi").select("line_id", "program", "line")


@query
def read_stored_dictionary(spark, sf_dir):
    # The dictionary written and read back
    return text.read_dictionary(spark, FL.write_dictionary(dictionary(spark, sf_dir), scratch_path(spark, "dictionary")))


@query
def stored_counts(spark, sf_dir):
    # K1: a result written as a table and read back
    path = FL.write_result(TP.template_counts(masked(spark, sf_dir)), scratch_path(spark, "result"))
    return spark.read.parquet(path)


@query
def stored_metrics(spark, sf_dir):
    # K5: a metrics row written as JSON and read back
    return spark.read.json(FL.write_metrics(confusion_matrix(spark, sf_dir), scratch_path(spark, "metrics")))


@query
def quarantined(spark, sf_dir):
    # the rendered log with every seventh line spoilt in one of four ways
    faulty = tables.spoil(log_lines(spark, sf_dir))
    return TP.quarantined_lines(faulty).select("line_id", "reason")


def _split(spark, sf_dir) -> str:
    return FL.split_by_program(parsed(spark, sf_dir), program_list(spark, sf_dir),
                               scratch_path(spark, "split"), rows_per_file=FILE_ROWS)


@query
def split_by_program(spark, sf_dir):
    back = spark.read.parquet(_split(spark, sf_dir))
    return back.select(F.col("program").cast("string").alias("program"), "line_id", "line")


@query
def compact_counts(spark, sf_dir):
    split = spark.read.parquet(_split(spark, sf_dir))
    out = FL.compact(split, "program", scratch_path(spark, "compact"), FILE_ROWS, order="line_id")
    counts = FL.file_counts(spark, out, "program")
    # hashed salts decide how many files there are; the rules they follow are exact
    return counts.select(F.col("program").cast("string").alias("program"), "n_lines",
                         (F.col("n_files") >= F.ceil(F.col("n_lines") / FILE_ROWS)).alias("enough_files"),
                         (F.col("largest") <= FILE_ROWS).alias("small_enough"))


@query
def gather_templates(spark, sf_dir):
    counts = TP.template_counts(masked(spark, sf_dir), ("program",))
    path = FL.write_template_counts(counts, "program", scratch_path(spark, "templates"))
    back = FL.gather(spark, path)
    return back.select(F.col("program").cast("string").alias("program"), "template", "cnt")


@query
def sentences_by_source(spark, sf_dir):
    return SN.sentence_stats(tables.document_lines(spark, sf_dir), "source", "line")


FILE_LINES = 1500      # log lines per text file of a controller group
PIECE = 400            # words of a file sentence


@query
def file_sentences(spark, sf_dir):
    # The log as text files per controller group and stretch of lines, read back file by file
    path = scratch_path(spark, "files")
    lines = parsed(spark, sf_dir).select(F.substring("host", 1, 6).alias("grp"), F.expr(f"(line_id - 1) div {FILE_LINES}").alias("stretch"), "line_id", "line")
    # one file per group and stretch: such rows meet in one task, in order
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (lines.repartition(n, "grp", "stretch").sortWithinPartitions("grp", "stretch", "line_id").select("grp", "stretch", "line")
     .write.partitionBy("grp", "stretch").text(path))
    pieces = SN.file_sentences(text.read_file_lines(spark, path + "/*/*/part-*"), PIECE)
    return pieces.select(F.regexp_extract("path", "grp=([^/]*)", 1).alias("grp"), F.regexp_extract("path", "stretch=([0-9]+)", 1).cast("long").alias("stretch"),
                         "piece", F.size("sentence").alias("n_words"), F.size(F.array_distinct("sentence")).alias("n_distinct"),
                         F.element_at("sentence", 1).alias("first_word"), F.element_at("sentence", -1).alias("last_word"))


@query
def file_embedding_sizes(spark, sf_dir):
    # M1 on whole-file sentences: the log written as files, read back, cut and embedded
    path = scratch_path(spark, "files")
    parsed(spark, sf_dir).select(F.substring("host", 1, 6).alias("grp"), "line").write.partitionBy("grp").text(path)
    pieces = SN.file_sentences(text.read_file_lines(spark, path + "/*/part-*"))
    return MD.embedding_table(MD.fit_word2vec(pieces)).select("word", F.size("vector").alias("size"))


# ---- milestone 5: LogSig ---------------------------------------------------------------


K = 10          # clusters
LOGSIG_ITER = 5


def logsig_input(spark, sf_dir, premask: bool = False) -> DataFrame:
    lines = log_lines(spark, sf_dir)
    return TK.with_logsig_tokens(lines, "line", premask).select("line_id", "tokens")


def clustered(spark, sf_dir) -> DataFrame:
    return LS.init_clusters(logsig_input(spark, sf_dir), K, "round_robin")


@query
def logsig_tokens(spark, sf_dir):
    tok = logsig_input(spark, sf_dir)
    return tok.select("line_id", F.size("tokens").alias("n_tokens"),
                      F.array_join("tokens", " ").alias("token_text"))


@query
def term_pairs(spark, sf_dir):
    return TK.term_pairs(logsig_input(spark, sf_dir), block=LS.LONG)


@query
def cluster_init(spark, sf_dir):
    return clustered(spark, sf_dir).select("line_id", "cluster")


@query
def pair_counts(spark, sf_dir):
    return LS.pair_counts(clustered(spark, sf_dir))


@query
def cluster_potential(spark, sf_dir):
    return LS.cluster_potential(clustered(spark, sf_dir))


@query
def logsig_scores(spark, sf_dir):
    return LS.move_scores(clustered(spark, sf_dir), K)


@query
def logsig_reassign(spark, sf_dir):
    moves = LS.best_moves(clustered(spark, sf_dir), K)
    return moves.select("line_id", "cluster", "new_cluster", (F.round("gain", 6) + F.lit(0.0)).alias("gain"))


@query
def logsig_clusters(spark, sf_dir):
    final = LS.logsig(logsig_input(spark, sf_dir), K, LOGSIG_ITER, init="hash")
    return LS.cluster_potential(final)


@query
def logsig_two_rounds(spark, sf_dir):
    return LS.logsig(logsig_input(spark, sf_dir), K, 2, init="round_robin").select("line_id", "cluster")


@query
def stored_clusters(spark, sf_dir):
    # K6: the cluster state of a run, written as a table and read back
    path = FL.write_dictionary(logsig_two_rounds(spark, sf_dir), scratch_path(spark, "clusters"))
    return text.read_dictionary(spark, path)


def signature_input(spark, sf_dir) -> DataFrame:
    p = parsed(spark, sf_dir)
    cluster = F.concat_ws(" ", F.col("program"), F.regexp_extract("message", r"^(\S+)", 1))
    lines = TK.with_logsig_tokens(p.select("line_id", cluster.alias("cluster"), "line"), premask=True)
    return lines.select("line_id", "cluster", "tokens")


@query
def logsig_signatures(spark, sf_dir):
    return LS.signatures(signature_input(spark, sf_dir), "skip_star")


@query
def logsig_signatures_literal(spark, sf_dir):
    return LS.signatures(signature_input(spark, sf_dir), "literal")


@query
def stored_signatures(spark, sf_dir):
    # K6: the signatures of all clusters, written as a table and read back
    path = FL.write_dictionary(logsig_signatures(spark, sf_dir), scratch_path(spark, "signatures"))
    return text.read_dictionary(spark, path)
