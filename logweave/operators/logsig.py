"""LogSig message-signature clustering (L1-L6) as DataFrame steps.

Lines are clustered so that term pairs shared inside a cluster are frequent.
For a cluster c with len(c) lines and a pair p, n_c(p) = lines of c that
contain p (the pair ``('*', '*')`` never counts).  Then

  potential(c) = sum over lines x in c, over pair occurrences p of x: n_c(p) * (n_c(p)/len(c))^2
  score(x, i -> j) = 3 * sum_p (n_j(p)/len_j)^2 - 3 * sum_p (n_i(p)/len_i)^2

Sums are exact integers (in limbs) put together and divided once, so the doubles
do not depend on summation order, and nothing overflows at any size.

Identical token arrays of a cluster are handled once, with a multiplicity:
a hot template (half of all lines, say) becomes one row before any pair is
formed.  Pairs are quadratic in a line's token count, inherent to the method; a
long line's pairs are dealt over tasks by blocks of tokens.

A pair with a word that no other distinct line has (an id, an address) is never
shared: its count is the line's multiplicity in the line's cluster and 0 elsewhere.
Such pairs are not formed but counted (``own`` occurrences), and lines that differ in
such words alone become one row (:func:`merged_lines`).  All sums stay exact.

Rounds work on changes: the lines' pairs and a table of each pair's counts per
cluster are formed once, and a round adds what its moved lines change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import STAR, term_pairs, with_signature
from ..session import written

BIG = "decimal(38,0)"


def init_clusters(lines: DataFrame, k: int, mode: str = "hash", seed: int = 42) -> DataFrame:
    """L1: initial cluster in 0..k-1 per line: seeded hash (``hash``) or ``round_robin`` by line id."""
    if mode == "hash":
        c = F.pmod(F.xxhash64(F.col("line_id"), F.lit(seed)), F.lit(k))
    elif mode == "round_robin":
        c = F.pmod(F.col("line_id"), F.lit(k))
    else:
        raise ValueError("mode must be 'hash' or 'round_robin'")
    return lines.withColumn("cluster", c.cast("int"))


def _fingerprint(tokens: str = "tokens"):
    """Two independent 64-bit hashes of a token array (a 128-bit key for joins)."""
    # a missing and an empty array hash alike, so the key says which it is
    return [F.xxhash64(F.col(tokens), F.col(tokens).isNull()).alias("_h1"),
            F.xxhash64(F.lit("logsig"), F.col(tokens), F.col(tokens).isNull()).alias("_h2")]


def distinct_lines(clustered: DataFrame) -> DataFrame:
    """One row per (cluster, token array): ``rep`` (lowest line id), ``mult``
    (lines) and the array's 128-bit fingerprint ``_h1, _h2``."""
    return (clustered.select("line_id", "cluster", "tokens", *_fingerprint())
            .groupBy("cluster", "tokens")
            .agg(F.min("line_id").alias("rep"), F.count(F.lit(1)).alias("mult"),
                 F.first("_h1").alias("_h1"), F.first("_h2").alias("_h2")))


def shared_lines(clustered: DataFrame) -> DataFrame:
    """``distinct_lines`` written once to the shared folder.

    For operators that read the distinct lines in several branches (pairs,
    lengths, the line-to-rep map): each branch would otherwise re-read and
    re-tokenise the log, since pushed-down filters and pruned columns make the
    branches differ and Spark cannot reuse one exchange for them.
    """
    return written(distinct_lines(clustered).withColumn("_row", F.monotonically_increasing_id()), "lines")


_HASH = ("_h1", "_h2")
_GROUP = ("_g1", "_g2")


def merged_lines(groups: DataFrame, parts: int = 1) -> tuple[DataFrame, DataFrame]:
    """Distinct lines of :func:`shared_lines` that differ only in words of their own, as one row.

    Returns ``(members, merged)``.  ``members``: the group ``_g1, _g2`` of every distinct line
    ``(cluster, _h1, _h2)``.  ``merged``: ``(cluster, tokens, rep, mult, each, own, _g1, _g2)``
    with the shared tokens, the lowest line id, all lines, the lines of one
    distinct line, and its pair occurrences that hold a word of its own.

    Lines of a group have equal multiplicities and equal line ids modulo ``parts``, so
    they score alike and move in the same rounds.  ``*`` is never a word of its own.
    """
    words = groups.select("_row", F.explode(F.array_distinct("tokens")).alias("_w")).where(F.col("_w") != STAR)
    single = (words.groupBy("_w").agg(F.min("_row").alias("_row"), F.max("_row").alias("_last"))
              .where(F.col("_row") == F.col("_last")))
    own = single.groupBy("_row").agg(F.collect_list("_w").alias("_own"))
    shared = F.when(F.col("_own").isNull(), F.col("tokens")).otherwise(
        F.filter("tokens", lambda x: ~F.coalesce(F.array_contains(F.col("_own"), x), F.lit(False))))

    def pairs(tokens):
        n = F.greatest(F.size(tokens), F.lit(0)).cast("long")
        return F.shiftright(n * (n - 1), 1)

    marked = groups.join(own, "_row", "left").select("cluster", "rep", "mult", *_HASH, "tokens", shared.alias("_shared"))
    marked = marked.select("cluster", "rep", "mult", *_HASH, F.col("_shared").alias("tokens"),
                           (pairs("tokens") - pairs("_shared")).alias("own"),
                           F.pmod("rep", F.lit(parts)).alias("_turn"))
    key = ["cluster", "tokens", "mult", "own", "_turn"]
    marked = written(marked.withColumns({
        "_g1": F.xxhash64(*key, F.col("tokens").isNull()),
        "_g2": F.xxhash64(F.lit("group"), *key, F.col("tokens").isNull())}), "marked")
    merged = marked.groupBy(*key).agg(F.min("rep").alias("rep"), F.count(F.lit(1)).alias("_n"),
                                      *[F.first(c).alias(c) for c in _GROUP])
    merged = merged.select("cluster", "tokens", "rep", (F.col("mult") * F.col("_n")).alias("mult"),
                           F.col("mult").alias("each"), "own", *_GROUP)
    return marked.select("cluster", *_HASH, *_GROUP), written(merged, "merged")


def _with_own(groups: DataFrame) -> DataFrame:
    """Distinct lines that were not merged have no own pairs: all their pairs are formed."""
    if "own" in groups.columns:
        return groups
    return groups.withColumns({"each": F.col("mult"), "own": F.lit(0).cast("long")})


PAIR_KEY = ["_p1", "_p2"]
TEXT_KEY = ["a", "b"]


def _pair_key(key: str) -> list[str]:
    if key not in ("hash", "text"):
        raise ValueError("key must be 'hash' or 'text'")
    return PAIR_KEY if key == "hash" else TEXT_KEY


LONG = 256            # tokens; longer lines are cut into blocks of so many


def line_pairs(groups: DataFrame, skip_star: bool = True, key: str = "hash", long: int = LONG) -> DataFrame:
    """Distinct pairs of each distinct line with their occurrence count ``occ``.

    ``groups`` is a written table.  Its lines of up to ``long`` tokens are hash-partitioned
    by ``rep`` first (a shuffle of one row per distinct line); every pair of such a line is
    then formed in the task that holds it, and the aggregate on (cluster, rep, mult,
    pair) needs no second shuffle of the much larger pair rows.  Longer lines are dealt
    over all tasks by pairs of blocks, and their pairs are counted before and after a shuffle.

    ``key="hash"`` identifies a pair by a 128-bit fingerprint ``_p1, _p2`` (two
    independently seeded 64-bit hashes of the two terms): later shuffles, joins
    and aggregates then carry and compare two longs instead of two strings.
    ``key="text"`` keeps the terms ``a, b`` (for output).
    """
    cols = _pair_key(key)
    keep = ("cluster", "rep", "mult")

    def counted(pairs):
        if skip_star:
            pairs = pairs.where(~((F.col("a") == STAR) & (F.col("b") == STAR)))
        if key == "hash":
            pairs = pairs.select(*keep, F.xxhash64("a", "b").alias("_p1"),
                                 F.xxhash64(F.lit("pair"), "a", "b").alias("_p2"))
        return pairs.groupBy(*keep, *cols).agg(F.count(F.lit(1)).alias("occ"))

    # an explicit partition count: adaptive coalescing would size this shuffle by
    # its (small) input bytes, not by the pairs each line explodes into
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.size("tokens")
    short = counted(term_pairs(groups.where(size <= long).repartition(n, "rep"), keep=keep))
    return short.unionByName(counted(term_pairs(groups.where(size > long), keep=keep, block=long)))


def pair_counts_of(lp: DataFrame, key: str = "hash") -> DataFrame:
    """n = lines of the cluster that contain the pair."""
    return lp.groupBy("cluster", *_pair_key(key)).agg(F.sum("mult").alias("n"))


def cluster_lengths(groups: DataFrame) -> DataFrame:
    """Lines per cluster."""
    return groups.groupBy("cluster").agg(F.sum("mult").alias("len"))


def pair_counts(clustered: DataFrame) -> DataFrame:
    """A13, F6 on ``(line_id, cluster, tokens)``: ``(cluster, a, b, n)``."""
    return pair_counts_of(line_pairs(shared_lines(clustered), key="text"), key="text")


def cluster_potential(clustered: DataFrame) -> DataFrame:
    """A12, A14 on ``(line_id, cluster, tokens)``: ``(cluster, len, potential)``."""
    _, groups = merged_lines(shared_lines(clustered))
    return potential_from(line_pairs(groups), cluster_lengths(groups), groups=groups)


def potential_from(lp: DataFrame, lens: DataFrame, key: str = "hash", groups: DataFrame | None = None) -> DataFrame:
    """A14 from line pairs ``(cluster, rep, mult, <pair>, occ)`` and lengths ``(cluster, len)``.

    Every occurrence of a pair adds n^3/len^2: per (cluster, pair) one
    aggregate gives n and the occurrence count m, and the numerator is
    sum(m * n^3), with no join of the line pairs back to their counts.  The
    product (m * n) * (n * n) is summed exactly in three limbs of base 10^12,
    so the same sums are taken at every size and do not depend on their order;
    the limbs meet in one double at the end.  ``groups``: merged lines, whose own pairs are added.
    """
    per_pair = lp.groupBy("cluster", *_pair_key(key)).agg(
        F.sum("mult").alias("n"), F.sum(F.col("mult") * F.col("occ")).alias("m"))
    return _potential(per_pair, lens, groups)


def _potential(per_pair: DataFrame, lens: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Potential per cluster from ``(cluster, n, m)`` per pair and the own pairs of ``groups``."""
    per_pair = per_pair.select("cluster", "n", "m", F.lit(1).cast("long").alias("w"))
    if groups is not None:
        # a distinct line's own pairs have n = each and each * own occurrences; mult / each such lines
        per_pair = per_pair.unionByName(groups.where("own > 0").select(
            "cluster", F.col("each").alias("n"), (F.col("each") * F.col("own")).alias("m"), F.expr("mult div each").alias("w")))
    n, m = F.col("n").cast(BIG), F.col("m").cast(BIG)
    factors = per_pair.select("cluster", "w", (m * n).cast(BIG).alias("x"), (n * n).cast(BIG).alias("y"))
    unit = 10 ** 12
    split = factors.select(
        "cluster", F.col("w").cast("decimal(19,0)").alias("w"),
        F.expr(f"x div {unit}BD").alias("x1"), (F.col("x") % F.lit(unit)).cast("long").alias("x0"),
        F.expr(f"y div {unit}BD").alias("y1"), (F.col("y") % F.lit(unit)).cast("long").alias("y0"))
    x1, x0, y1, y0 = (F.col(c).cast("decimal(19,0)") for c in ("x1", "x0", "y1", "y0"))
    w = F.col("w")
    num = split.groupBy("cluster").agg(F.sum(((x1 * y1).cast(BIG) * w).cast(BIG)).alias("_s2"),
                                       F.sum((((x1 * y0).cast(BIG) + (x0 * y1).cast(BIG)).cast(BIG) * w).cast(BIG)).alias("_s1"),
                                       F.sum(((x0 * y0).cast(BIG) * w).cast(BIG)).alias("_s0"))
    out = lens.join(num, "cluster", "left")
    total = (F.col("_s2").cast("double") * 1e24 + F.col("_s1").cast("double") * 1e12 + F.col("_s0").cast("double"))
    sq = F.pow(F.col("len").cast("double"), 2)     # len^2 passes a long past 3e9 lines
    return out.select("cluster", "len", F.coalesce(total / sq, F.lit(0.0)).alias("potential"))


def pair_table(lp: DataFrame, k: int) -> DataFrame:
    """``(<pair>, n0.., m0..)``: per cluster the lines that contain the pair, and its occurrences in them."""
    def of(c, value):
        return F.coalesce(F.sum(F.when(F.col("cluster") == c, value)), F.lit(0)).cast("long")

    return lp.groupBy(*PAIR_KEY).agg(*[of(c, F.col("mult")).alias(f"n{c}") for c in range(k)],
                                     *[of(c, F.col("mult") * F.col("occ")).alias(f"m{c}") for c in range(k)])


_BITS = 28
_LOW = (1 << _BITS) - 1


def _square_limbs(n):
    """n * n of a count below 2^42 in three limbs of 28 bits.

    With n = a 2^21 + b the square is a^2 2^42 + ab 2^22 + b^2; ab is cut at 6 bits to meet 2^28.
    """
    a, b = F.shiftright(n, 21), n.bitwiseAND(F.lit((1 << 21) - 1))
    low = F.shiftleft((a * b).bitwiseAND(F.lit(63)), 22) + b * b
    high = F.shiftleft(a * a, 14) + F.shiftright(a * b, 6) + F.shiftright(low, _BITS)
    return [low.bitwiseAND(F.lit(_LOW)), high.bitwiseAND(F.lit(_LOW)), F.shiftright(high, _BITS)]


def _sums(terms: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """``(rep, _A)``: the k sums A_c = sum over the line's pair occurrences of n_c(p)^2, from ``terms``
    ``(rep, <pair>, occ)`` and the pair table.

    Squares are summed as limbs, in longs, and put together as one decimal per
    line: exact at any count.  Both sides are written tables, so adaptive execution can split a hot pair.
    """
    joined = terms.select("rep", "occ", *PAIR_KEY).join(table.select(*PAIR_KEY, *[f"n{c}" for c in range(k)]), PAIR_KEY)
    sums = joined.groupBy("rep").agg(*[F.sum(F.col("occ") * limb).alias(f"_A{c}_{i}")
                                       for c in range(k) for i, limb in enumerate(_square_limbs(F.col(f"n{c}")))])

    def whole(c):
        limb = [F.col(f"_A{c}_{i}").cast("decimal(19,0)") for i in range(3)]
        return ((limb[2] * F.lit(1 << 2 * _BITS).cast("decimal(17,0)")).cast(BIG)
                + (limb[1] * F.lit(1 << _BITS).cast("decimal(9,0)")).cast(BIG) + limb[0]).cast(BIG)

    return sums.select("rep", F.array(*[whole(c) for c in range(k)]).alias("_A"))


def _with_sums(groups: DataFrame, sums: DataFrame, k: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(rep, ci, *keep, _A)``; lines without any pair still get a sum (0) for every cluster.

    Own pairs add ``own * each^2`` to the sum of the line's own cluster.
    """
    zero = F.array(*[F.lit(0).cast(BIG) for _ in range(k)])
    square = (F.col("each").cast(BIG) * F.col("each").cast(BIG)).cast(BIG)
    rows = _with_own(groups).select("rep", F.col("cluster").alias("ci"), *keep, (square * F.col("own").cast(BIG)).cast(BIG).alias("_own"))
    full = rows.join(sums, "rep", "left").withColumn("_A", F.coalesce("_A", zero))
    added = F.transform("_A", lambda a, c: F.when(c == F.col("ci"), (a + F.col("_own")).cast(BIG)).otherwise(a))
    return full.select("rep", "ci", *keep, added.alias("_A"))


def rep_vectors(groups: DataFrame, k: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(rep, ci, *keep, _A)`` per distinct line: its cluster and its k sums (see :func:`_sums`).

    The pairs of every line are formed once and written, as is the table of their counts.
    """
    lp = written(line_pairs(groups), "pairs")
    return _with_sums(groups, _sums(lp, written(pair_table(lp, k), "table"), k), k, keep)


def _score_targets(vectors: DataFrame, lens: DataFrame, k: int, keep: tuple[str, ...]) -> DataFrame:
    """One row per other cluster cj: ``(*keep, ci, cj, score)`` from ``(*keep, ci, _A)``."""
    targets = vectors.select(*keep, "ci", "_A", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("cj"))
    targets = targets.where(F.col("cj") != F.col("ci"))
    len_i = lens.select(F.col("cluster").alias("ci"), F.col("len").alias("len_i"))
    len_j = lens.select(F.col("cluster").alias("cj"), F.col("len").alias("len_j"))
    # clusters without lines have no length row: moving there scores as an empty cluster
    scored = (targets.join(F.broadcast(len_i), "ci")
              .join(F.broadcast(len_j), "cj", "left"))   # k rows each

    def term(a, ln):
        return (a * 3).cast("double") / F.pow(F.col(ln).cast("double"), 2)

    a_j = F.element_at(F.col("_A"), F.col("cj") + 1)
    a_i = F.element_at(F.col("_A"), F.col("ci") + 1)
    gain_j = F.when(F.col("len_j").isNull(), F.lit(0.0)).otherwise(term(a_j, "len_j"))
    score = gain_j - term(a_i, "len_i")
    return scored.select(*keep, "ci", "cj", score.alias("score"))


def rep_scores(groups: DataFrame, k: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scores ``(rep, *keep, ci, cj, score)`` of every distinct line for every other cluster 0..k-1."""
    return _score_targets(rep_vectors(groups, k, keep), cluster_lengths(groups), k, ("rep", *keep))


def _keyed(clustered: DataFrame) -> DataFrame:
    """Lines with the 128-bit fingerprint of their tokens instead of the tokens."""
    return clustered.select("line_id", "cluster", *_fingerprint())


def move_scores(clustered: DataFrame, k: int, digits: int | None = 6) -> DataFrame:
    """L3: ``(line_id, cluster, target, score)`` for every line and every other cluster.

    A group of merged lines is scored once; lines meet their group by one join on
    (cluster, fingerprint), and its k-1 scores by another.
    """
    members, groups = merged_lines(shared_lines(clustered))
    scored = _score_targets(rep_vectors(groups, k, _GROUP), cluster_lengths(groups), k, _GROUP)
    score = F.round("score", digits) + F.lit(0.0) if digits is not None else F.col("score")
    scores = written(scored.select(*_GROUP, F.col("cj").alias("target"), score.alias("score")), "scores")
    located = _keyed(clustered).join(members, ["cluster", *_HASH])
    return located.join(scores, [*_GROUP]).select("line_id", "cluster", "target", "score")


def _decide(scores: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Best other cluster per distinct line: ``(rep, *keep, ci, _to, gain)``; ``_to`` null = stay."""
    best = scores.groupBy("rep", *keep, "ci").agg(
        F.max(F.struct(F.col("score"), (-F.col("cj")).alias("neg_j"))).alias("_b"))
    moved = F.col("_b.score") > 0
    return best.select("rep", *keep, "ci",
                       F.when(moved, -F.col("_b.neg_j")).alias("_to"),
                       F.when(moved, F.col("_b.score")).otherwise(F.lit(0.0)).alias("gain"))


def best_moves(clustered: DataFrame, k: int) -> DataFrame:
    """L4, one synchronous round: each line goes to its best other cluster if the
    score is positive (ties to the lowest cluster), else stays.

    ``(line_id, cluster, new_cluster, gain)``; ``gain`` is the exact double.
    """
    members, groups = merged_lines(shared_lines(clustered))
    decided = written(_decide(rep_scores(groups, k, _GROUP), _GROUP), "moves")
    per_line = _keyed(clustered).join(members, ["cluster", *_HASH]).join(decided.select(*_GROUP, "_to", "gain"), [*_GROUP])
    return per_line.select("line_id", "cluster",
                           F.coalesce(F.col("_to"), F.col("cluster")).cast("int").alias("new_cluster"),
                           "gain")


def _table_potential(table: DataFrame, state: DataFrame, k: int) -> float:
    """Total potential from the pair table and the own pairs of ``state``."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("cluster"), F.col(f"n{c}").alias("n"), F.col(f"m{c}").alias("m")) for c in range(k)]))
    per_pair = table.select(rows.alias("_r")).select("_r.*").where("n > 0")
    return _potential(per_pair, cluster_lengths(state), state).agg(F.sum("potential")).first()[0] or 0.0


def _changed(table: DataFrame, terms: DataFrame, moves: DataFrame, k: int) -> DataFrame:
    """The pair table after ``moves`` ``(rep, mult, _from, _to)``: only the moved lines' pairs are looked at."""
    def change(c, value):
        sign = F.when(F.col("_to") == c, value).when(F.col("_from") == c, -value)
        return F.coalesce(F.sum(sign), F.lit(0)).cast("long")

    moved = terms.join(moves, "rep")
    delta = moved.groupBy(*PAIR_KEY).agg(*[change(c, F.col("mult")).alias(f"_n{c}") for c in range(k)],
                                         *[change(c, F.col("mult") * F.col("occ")).alias(f"_m{c}") for c in range(k)])
    cols = [f"{x}{c}" for x in "nm" for c in range(k)]
    return table.join(delta, PAIR_KEY, "left").select(*PAIR_KEY, *[(F.col(x) + F.coalesce(F.col(f"_{x}"), F.lit(0))).alias(x) for x in cols])


def rounds(groups: DataFrame, k: int, max_iter: int, parts: int):
    """Rounds of moves on distinct lines; yields ``(state, table)`` before the first and after every round.

    ``state``: ``(rep, cluster, mult, each, own)``; ``table``: the pair table of that state.  The lines' pairs
    are formed once.  A round scores only the lines whose turn it is, and the table
    follows from the moved lines' pairs alone.
    """
    lp = written(line_pairs(groups), "pairs")
    terms = lp.select("rep", *PAIR_KEY, "occ")
    state, table = _with_own(groups).select("rep", "cluster", "mult", "each", "own"), written(pair_table(lp, k), "table")
    best, idle = _table_potential(table, state, k), 0
    yield state, table
    for r in range(max_iter):
        turn = F.pmod(F.col("rep") + r, F.lit(parts)) == 0
        vectors = _with_sums(state.where(turn), _sums(terms.where(turn), table, k), k)
        decided = _decide(_score_targets(vectors, cluster_lengths(state), k, ("rep",)))
        moves = written(decided.where(F.col("_to").isNotNull()).join(state.select("rep", "mult"), "rep")
                        .select("rep", "mult", F.col("ci").alias("_from"), F.col("_to").cast("int").alias("_to")), "moves")
        proposal = written(state.join(moves.select("rep", "_to"), "rep", "left").select(
            "rep", F.coalesce("_to", "cluster").alias("cluster"), "mult", "each", "own"), "state")
        changed = written(_changed(table, terms, moves, k), "table")
        value = _table_potential(changed, proposal, k)
        if value > best:
            state, table, best, idle = proposal, changed, value, 0
        else:
            idle += 1
        yield state, table
        if idle == parts:
            return


def logsig(tokens: DataFrame, k: int = 10, max_iter: int = 10, init: str = "hash",
           seed: int = 42, parts: int = 2) -> DataFrame:
    """L1-L4: iterate synchronous moves while the total potential rises.

    ``tokens``: ``(line_id, tokens)`` -> ``(line_id, cluster, tokens)``.  The state is
    one row per group of merged lines of the initial clustering (they
    always score alike and share their turns, so they move together).  In round r only the
    lines with (rep + r) mod ``parts`` = 0 may move: if all moved at once on the
    old counts, groups would swap places or fall together.  A round that does
    not raise the potential is taken back; ``parts`` such rounds in a row end the
    iteration.  Every round is written to the shared folder, so lineage stays
    short; only one number per round (the potential) reaches the driver.
    """
    lines = init_clusters(tokens.select("line_id", "tokens"), k, init, seed)
    members, groups = merged_lines(shared_lines(lines), parts)
    for state, _ in rounds(groups, k, max_iter, parts):
        pass
    final = written(groups.select("rep", *_GROUP).join(state.select("rep", F.col("cluster").alias("final")), "rep").drop("rep"), "final")
    keyed = lines.select("line_id", "cluster", "tokens", *_fingerprint())
    located = keyed.join(members, ["cluster", *_HASH]).join(final, [*_GROUP])
    return located.select("line_id", F.col("final").alias("cluster"), "tokens")


def signatures(clustered: DataFrame, rule: str = "skip_star") -> DataFrame:
    """L5 + L6: keep a line when every pair of it occurs in at least half of its
    cluster's lines, then count lines per (cluster, signature).

    ``skip_star``: the pair ('*','*') is not checked.  ``literal``: it always
    fails (n = 0), so a line holding it is dropped, as in the reference.
    """
    groups = shared_lines(clustered)
    lp = line_pairs(groups, skip_star=True)
    n = pair_counts_of(lp)
    lens = cluster_lengths(groups)
    failing = (lp.join(n, ["cluster", *PAIR_KEY]).join(lens, "cluster")
               .where(F.col("n") * 2 < F.col("len")).select("rep").distinct())
    kept = groups.join(failing, "rep", "left_anti")
    if rule == "literal":
        star_pair = F.size(F.filter("tokens", lambda x: x == STAR)) >= 2
        kept = kept.where(~star_pair)
    elif rule != "skip_star":
        raise ValueError("rule must be 'skip_star' or 'literal'")
    signed = with_signature(kept)
    return signed.groupBy("cluster", "signature").agg(F.sum("mult").alias("cnt"))
