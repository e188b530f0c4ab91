"""Same or near-same records across splits, by segmented similarity fingerprints within a Hamming radius.

A record is the set of its features. Its fingerprint has a number of segments; each feature falls into one of them
and flips its hash's bits there, so a segment's code block is the parity of the features in it. Two sets that differ
in ``r`` features differ in at most ``r`` blocks: of ``r + 2`` blocks at least two agree. With a required Jaccard
similarity the sizes of two sets fix ``r``, so joining pairs of agreeing blocks loses no pair. Where the agreeing blocks
may be empty, a second fingerprint tells the sets apart. Candidates are verified on the features themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenorank.session import written

#: Jaccard similarity as a fraction, kept whole so that no rounding moves a pair over the line.
LEAST = (3, 4)
#: Up to this radius two agreeing blocks are joined, beyond it one.
PAIRED_RADIUS = 8

_ACCENTED = "ÀÁẢÃẠĂẰẮẲẴẶÂẦẤẨẪẬÈÉẺẼẸÊỀẾỂỄỆÌÍỈĨỊÒÓỎÕỌÔỒỐỔỖỘƠỜỚỞỠỢÙÚỦŨỤƯỪỨỬỮỰỲÝỶỸỴĐ"
_BARE = "AAAAAAAAAAAAAAAAAEEEEEEEEEEEIIIIIOOOOOOOOOOOOOOOOOUUUUUUUUUUUYYYYYD"


def bare(column: F.Column) -> F.Column:
    """Upper case without accents, blanks and separators."""
    text = F.translate(F.upper(column), _ACCENTED, _BARE)
    return F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")


def side(split: F.Column) -> F.Column:
    """'train', 'validation' or 'test' by the meaning of a split's name, else null."""
    name = F.lower(bare(split))
    return (
        F.when(name.isin("train", "training", "trn", "huanluyen"), "train")
        .when(name.isin("validation", "valid", "val", "dev", "development"), "validation")
        .when(name.isin("test", "testing", "tst", "kiemtra"), "test")
    )


def status_code(status: F.Column) -> F.Column:
    name = bare(status)
    return F.when(name.isin("CO", "PRESENT"), "PRESENT").when(name.isin("NGHINGO", "SUSPECTED"), "SUSPECTED").when(name.isin("KHONG", "ABSENT"), "ABSENT").otherwise(name)


def records(cases: DataFrame) -> DataFrame:
    """``(case_id, split, source, gold, features)``, one row per case and split.

    ``gold`` is the sorted set of gold diseases as text, ``features`` the sorted set of (hpo_id, status). Null ids and
    statuses are no features; cases without a gold disease, without a feature or with an unknown split are left out,
    since they say nothing that could be compared. Rows that repeat a case count once, their features as one set.
    """
    slim = cases.select(
        "case_id",
        side(F.col("split")).alias("split"),
        F.col("reference_standard.source").alias("source"),
        F.array_sort(F.array_distinct(F.filter(F.transform("gold_disease_ids", bare), lambda x: x.isNotNull() & (x != "")))).alias("gold"),
        F.array_distinct(
            F.filter(
                F.transform("observations", lambda o: F.concat_ws("|", F.nullif(bare(o["hpo_id"]), F.lit("")), F.nullif(status_code(o["status"]), F.lit("")))),
                lambda x: x.contains("|"),
            )
        ).alias("features"),
    ).where("case_id is not null and split is not null")
    once = slim.groupBy("case_id", "split").agg(
        F.min("source").alias("source"), F.flatten(F.collect_set("gold")).alias("gold"), F.flatten(F.collect_set("features")).alias("features")
    )
    return once.select(
        "case_id", "split", "source", F.array_join(F.array_sort(F.array_distinct("gold")), ",").alias("gold"), F.array_sort(F.array_distinct("features")).alias("features")
    ).where("gold <> '' and size(features) > 0")


def block_keys(sets: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """``(key, cls)``: the agreeing-block keys under which each set of ``sets(cls, gold, features)`` is looked up.

    For sizes a and b and Jaccard p/q the sets differ in at most (a + b)(q - p)/(q + p) features; a set emits keys for
    each radius that some partner size gives. Radii above ``PAIRED_RADIUS`` are rounded up to a grid, which keeps the
    keys of a large set linear in its size.
    """
    p, q = least
    n = sets.withColumn("n", F.size("features")).withColumn("codes", F.transform("features", lambda x: F.xxhash64(x)))
    grid = f"r -> if(r <= {PAIRED_RADIUS}, r, cast(ceil(r / shiftleft(1, cast(log2(r) as int) - 2)) * shiftleft(1, cast(log2(r) as int) - 2) as int))"
    radii = f"array_distinct(transform(transform(sequence(cast(ceil(n * {p} / {q}) as int), cast(floor(n * {q} / {p}) as int)), b -> cast(floor((n + b) * {q - p} / {q + p}) as int)), {grid}))"
    r = n.select("cls", "gold", "codes", F.explode(F.expr(radii)).alias("r")).withColumn("segments", F.expr(f"if(r <= {PAIRED_RADIUS}, r + 2, r + 1)"))
    fold = "transform(sequence(0, segments - 1), i -> aggregate(filter({0}, c -> pmod(c, segments) = i), 0L, (x, c) -> x ^ xxhash64(c)))"
    blocks = r.withColumn("blocks", F.expr(fold.format("codes"))).withColumn("again", F.expr(fold.format("transform(codes, c -> xxhash64(c, 2))")))
    # blocks without a feature agree in many sets: their key takes up those of a second fingerprint, of which as many agree
    second_pairs = "flatten(transform(sequence(0, segments - 2), k -> transform(sequence(k + 1, segments - 1), l -> xxhash64(gold, r, i, j, k, l, again[k], again[l]))))"
    second_single = "transform(sequence(0, segments - 1), k -> xxhash64(gold, r, i, k, again[k]))"
    pairs = f"flatten(flatten(transform(sequence(0, segments - 2), i -> transform(sequence(i + 1, segments - 1), j -> if(blocks[i] = 0 and blocks[j] = 0, {second_pairs}, array(xxhash64(gold, r, i, j, blocks[i], blocks[j])))))))"
    single = f"flatten(transform(sequence(0, segments - 1), i -> if(blocks[i] = 0, {second_single}, array(xxhash64(gold, r, i, blocks[i])))))"
    return blocks.select("cls", F.explode(F.expr(f"if(r <= {PAIRED_RADIUS}, {pairs}, {single})")).alias("key"))


def class_pairs(recs: DataFrame, least: tuple[int, int] = LEAST) -> tuple[DataFrame, DataFrame]:
    """``(pairs(cls_train, cls_eval), members(cls, case_id, split, source))``.

    Records with the same gold set and features are one class, so exact copies aren't compared with each other; pairs
    stand between a class with training records and one with evaluation records (which may be the same class).
    """
    p, q = least
    keyed = recs.withColumn("cls", F.xxhash64("gold", F.concat_ws(",", "features")))
    members = keyed.select("cls", "case_id", "split", "source")
    sets, _ = written(
        keyed.groupBy("cls").agg(
            F.min("gold").alias("gold"),
            F.first("features").alias("features"),
            F.max(F.col("split") == "train").alias("in_train"),
            F.max(F.col("split") != "train").alias("in_eval"),
        ),
        "classes",
    )
    left = block_keys(sets.where("in_train"), least).withColumnRenamed("cls", "cls_train")
    right = block_keys(sets.where("in_eval"), least).withColumnRenamed("cls", "cls_eval")
    near = left.join(right, "key").where("cls_train <> cls_eval").select("cls_train", "cls_eval").distinct()
    a = sets.select(F.col("cls").alias("cls_train"), F.col("gold").alias("gold_a"), F.col("features").alias("fa"))
    b = sets.select(F.col("cls").alias("cls_eval"), F.col("gold").alias("gold_b"), F.col("features").alias("fb"))
    common = F.size(F.array_intersect("fa", "fb"))
    sure = near.join(a, "cls_train").join(b, "cls_eval").where("gold_a = gold_b").where(common * F.lit(q) >= (F.size("fa") + F.size("fb") - common) * F.lit(p))
    same = sets.where("in_train and in_eval").select(F.col("cls").alias("cls_train"), F.col("cls").alias("cls_eval"))
    return sure.select("cls_train", "cls_eval").unionByName(same), members


def leaked_pairs(cases: DataFrame) -> DataFrame:
    """``(train_id, eval_id, split, source)``: each training case with each evaluation case it nearly equals."""
    pairs, members = class_pairs(records(cases))
    train = members.where("split = 'train'").select(F.col("cls").alias("cls_train"), F.col("case_id").alias("train_id"))
    evals = members.where("split <> 'train'").select(F.col("cls").alias("cls_eval"), F.col("case_id").alias("eval_id"), "split", "source")
    return pairs.join(evals, "cls_eval").join(train, "cls_train").where("train_id <> eval_id").select("train_id", "eval_id", "split", "source").distinct()


def found(spark: SparkSession, cases: DataFrame) -> DataFrame:
    """``(case_id_a, case_id_b)``, the smaller id first; distinct."""
    pairs = leaked_pairs(cases)
    return pairs.select(F.least("train_id", "eval_id").alias("case_id_a"), F.greatest("train_id", "eval_id").alias("case_id_b")).distinct()


def report(cases: DataFrame) -> DataFrame:
    """``(split, source, cases, leaked_cases)``: evaluation cases, and how many of them have a near copy in training.

    Counted at class level, so that copies are never expanded into pairs. A null source is a source of its own.
    """
    pairs, members = class_pairs(records(cases))
    hit = pairs.select(F.col("cls_eval").alias("cls")).distinct().withColumn("hit", F.lit(1))
    evals = members.where("split <> 'train'").join(hit, "cls", "left")
    return evals.groupBy("split", "source").agg(F.countDistinct("case_id").alias("cases"), F.countDistinct(F.when(F.col("hit") == 1, F.col("case_id"))).alias("leaked_cases"))
