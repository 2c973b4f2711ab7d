"""Secret scans: patterns, and a randomness test battery with false-discovery control. DataFrame functions only.

Every long run of key characters is a candidate. Its encoding (hex, base32, base64) is inferred, its characters become
numbers, and three tests ask whether they look drawn at random: chi-squared uniformity over the encoding's alphabet, a
runs test about the middle of the alphabet, and the correlation of each character with the next. A candidate that a
random source would hardly give (least of the three p values times three, below ALPHA) is dismissed.

For the rest the null hypothesis is ordinary writing, of which two things are known. Letters repeat: over an alphabet of k
letters, text with index of coincidence C has a chi-squared statistic near (k-1) + n*(k*C-1), so short runs can hardly be
told from text and long ones can. And the kind of character seldom changes from one to the next (a capital that begins a
word and joining marks don't count): at most in SWITCH of all places, so that Chernoff's bound limits the chance of as
many changes as there are. The two p values are put together by Fisher's method; over the 16 hex digits the first has no
power, and the second is used alone. Short base32 keys change least often: of those with 26 characters about half are found,
of those with 40 nearly all. Within each class of length and encoding the Benjamini-Hochberg rule (over all
candidates of the whole table, p values rounded up to steps of the grid) keeps false discoveries below FDR.

Defined results: a null or empty text has no spans. Repeated rows each count as tests and are each reported. Ties in p
share one decision. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import SPAN, matches, of_kind, rendered, uncovered
from .textops import checkpoint, quoted, table

# The patterns of the contract. Possessive quantifiers and boundaries only keep the search linear.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)$"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]++"
KINDS = ("assign", "access", "hex", "random")

ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"}
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+"
#: Chance that two letters of European writing are alike.
COINCIDENCE = 0.066
#: How often, at most, writing changes between small letters, capitals and digits from one character to the next.
SWITCH = 0.12
CHANGE = r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
ALPHA = 0.001
FDR = 0.01
LENGTHS = (20, 28, 40, 64, 128)
STEPS = 40  # of the grid of p values, for each factor of ten
LEAST = 40  # smallest p value told apart: 10**-LEAST


def base_spans(text: Column) -> dict[str, Column]:
    assign = matches(text, ASSIGN, text.rlike(r"[:=]"))
    access = matches(text, ACCESS, F.contains(text, F.lit("AKIA")))
    # A run of 32 or more is found by its own pattern: shorter runs would only be dropped again.
    runs = matches(text, HEX.replace("++", "{32,}+"), F.lit(True))
    return {
        "assign": F.filter(assign, lambda s: F.length(F.regexp_extract(s["value"], ASSIGN_VALUE, 1)) >= 8),
        "access": F.filter(access, lambda s: s["stop"] - s["start"] >= 16),
        "hex": runs,
    }


def with_tail(d: DataFrame, name: str, z: str) -> DataFrame:
    """Add the upper tail of the normal distribution at column `z` as `name`; by its asymptotic form far out.

    Each step is a column of its own, so that no expression holds copies of another."""
    a, t = f"{name}_a", f"{name}_t"
    d = d.withColumn(a, F.abs(F.col(z))).withColumn(t, 1 / (1 + 0.2316419 * F.col(a)))
    density = F.exp(-F.col(a) * F.col(a) / 2) * 0.3989422804014327
    t_ = F.col(t)
    series = t_ * (0.319381530 + t_ * (-0.356563782 + t_ * (1.781477937 + t_ * (-1.821255978 + t_ * 1.330274429))))
    d = d.withColumn(a, density * F.when(F.col(a) > 6, 1 / F.greatest(F.col(a), F.lit(1.0))).otherwise(series))
    return d.withColumn(name, F.when(F.col(z) >= 0, F.col(a)).otherwise(1 - F.col(a))).drop(a, t)


def place_in(alphabet: str):
    return lambda c: F.instr(F.lit(alphabet), c) - 1


def decoded(d: DataFrame) -> DataFrame:
    """For rows with a column `token`: its encoding, length n, alphabet size k and the place of each character in the alphabet."""
    d = d.withColumn("body", F.regexp_replace("token", "=+$", "")).withColumn("n", F.length("body").cast("double"))
    d = d.withColumn("encoding", F.when(F.col("body").rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(F.col("body").rlike("^[A-Z2-7]+$"), "base32").otherwise("base64"))
    d = d.withColumn("letters", F.filter(F.split(F.when(F.col("encoding") == "hex", F.lower("body")).otherwise(F.col("body")), ""), lambda c: c != ""))
    places, k = F.lit(None).cast("array<int>"), F.lit(None).cast("double")
    for name, alphabet in ALPHABETS.items():
        places = F.when(F.col("encoding") == name, F.transform("letters", place_in(alphabet))).otherwise(places)
        k = F.when(F.col("encoding") == name, float(min(len(alphabet), 64))).otherwise(k)
    d = d.withColumn("k", k).withColumn("codes", places)
    # '-' and '_' share the places of '+' and '/'.
    d = d.withColumn("codes", F.transform("codes", lambda c: F.when(c >= 64, c - 2).otherwise(c)))
    return d.withColumn("changes", (F.length(F.regexp_replace("body", CHANGE, " ")) - F.length("body")).cast("double")).drop("body", "letters")


def run_battery(tokens: DataFrame) -> DataFrame:
    """Add encoding, n, p_random (the three tests) and p_text (against ordinary writing) to rows with a column `token`."""
    count = lambda i: F.size(F.filter("codes", lambda c: c == i)).cast("double")
    d = decoded(tokens).withColumn("squares", F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0.0), lambda acc, i: acc + count(i) * count(i)))
    k, n = F.col("k"), F.col("n")
    d = d.withColumn("chi", F.greatest(k / n * F.col("squares") - n, F.lit(0.0))).withColumn("excess", n * F.greatest(k * COINCIDENCE - 1, F.lit(0.0)))
    # Wilson and Hilferty: the cube root of chi-squared over its degrees of freedom is nearly normal.
    spread = 2 / (9 * (k - 1))
    d = d.withColumn("z_uniform", (F.pow(F.col("chi") / (k - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))
    d = d.withColumn("z_writing", -(F.col("chi") - (k - 1 + F.col("excess"))) / F.sqrt(2 * (k - 1) + 4 * F.col("excess")))
    d = d.withColumn("middle", (k - 1) / 2)
    state = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("runs"), F.lit(0).alias("high"), F.lit(0.0).alias("cross"), F.lit(0.0).alias("prior"), F.lit(0.0).alias("sum2"))

    def step(acc: Column, c: Column) -> Column:
        x = c - F.col("middle")
        side = F.when(x > 0, 1).otherwise(0)
        return F.struct(
            side.alias("last"),
            (acc["runs"] + F.when(side == acc["last"], 0).otherwise(1)).alias("runs"),
            (acc["high"] + side).alias("high"),
            (acc["cross"] + acc["prior"] * x).alias("cross"),
            x.alias("prior"),
            (acc["sum2"] + x * x).alias("sum2"),
        )

    d = d.withColumn("walk", F.aggregate("codes", state, step))
    d = d.withColumn("both", 2 * F.col("walk.high") * (n - F.col("walk.high")))
    d = d.withColumn("variance", F.col("both") * (F.col("both") - n) / (n * n * F.greatest(n - 1, F.lit(1.0))))
    d = d.withColumn("z_runs", F.when(F.col("variance") > 0, F.abs((F.col("walk.runs") - F.col("both") / n - 1) / F.sqrt("variance"))).otherwise(9.0))
    d = d.withColumn("z_serial", F.when(F.col("walk.sum2") > 0, F.abs(F.col("walk.cross") / F.col("walk.sum2") * F.sqrt(n))).otherwise(9.0))
    for name in ("uniform", "runs", "serial", "writing"):
        d = with_tail(d, f"p_{name}", f"z_{name}")
    p_random = F.least(F.lit(1.0), 3 * F.least("p_uniform", 2 * F.col("p_runs"), 2 * F.col("p_serial")))
    pairs = F.greatest(n - 1, F.lit(1.0))
    rate = F.least(F.col("changes") / pairs, F.lit(1.0))
    entropy = lambda x, at: F.when(x > 0, x * F.log(x / at)).otherwise(0.0)
    bound = F.when(rate > SWITCH, F.exp(-pairs * (entropy(rate, SWITCH) + entropy(1 - rate, 1 - SWITCH)))).otherwise(1.0)
    d = d.withColumn("p_changes", F.greatest(bound, F.lit(1e-150)))
    d = d.withColumn("product", F.col("p_changes") * F.greatest("p_writing", F.lit(1e-150)))
    p_text = F.when(F.col("excess") < 0.1 * n, F.col("p_changes")).otherwise(F.least(F.lit(1.0), F.col("product") * (1 - F.log("product"))))
    return d.select(*tokens.columns, "encoding", "n", p_random.alias("p_random"), p_text.alias("p_text"))


def length_class(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(LENGTHS):
        out = F.when(n >= least, i).otherwise(out)
    return out


def grid(p: Column) -> Column:
    """Step of the grid that a p value is rounded up to: 0 is 1, larger steps are smaller p values."""
    return F.floor(F.least(F.lit(float(LEAST)), -F.log10(F.greatest(p, F.lit(1e-300)))) * STEPS).cast("int")


def discoveries(tests: DataFrame) -> DataFrame:
    """For each class and encoding, the least step that is a discovery (null: none). A row for each step at most: small."""
    counts = tests.groupBy("cls", "encoding", "step").agg(F.count("*").alias("m"), F.count(F.when(F.col("p_random") >= ALPHA, 1)).alias("hits"))
    of = lambda d: F.transform(F.filter(F.col("steps"), lambda x: x["step"] >= d), lambda x: x["hits"])
    packed = counts.groupBy("cls", "encoding").agg(F.sum("m").alias("total"), F.array_sort(F.collect_list(F.struct("step", "hits"))).alias("steps"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x)
    passing = F.filter("steps", lambda s: (s["hits"] > 0) & (F.pow(F.lit(10.0), -s["step"] / STEPS) * F.col("total") <= FDR * total(of(s["step"]))))
    return packed.select("cls", "encoding", F.array_min(F.transform(passing, lambda s: s["step"])).alias("least_step"))


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans (order, kind, start, stop) by start, then kind, of every row; value holds what was matched."""
    t = F.coalesce(quoted(text).cast("string"), F.lit(""))
    base = base_spans(t)
    found = docs.select(
        quoted(id_column).alias("doc_id"),
        F.concat(*[of_kind(base[k], i, k) for i, k in enumerate(KINDS[:3])]).alias("base"),
        matches(t, CANDIDATE, F.lit(True)).alias("candidates"),
    ).withColumn("candidates", uncovered(F.col("candidates"), F.col("base")))
    found = checkpoint(found.withColumn("row_id", F.monotonically_increasing_id()))
    tokens = found.select("row_id", F.explode("candidates").alias("c"))
    tests = run_battery(tokens.select("row_id", "c", F.col("c.value").alias("token")))
    tests = tests.withColumn("cls", length_class(F.col("n"))).withColumn("step", grid(F.col("p_text")))
    tests = checkpoint(tests.select("row_id", "c", "cls", "encoding", "step", "p_random"))
    # At most one row for each of the few classes: a broadcast of fixed size.
    kept = tests.join(F.broadcast(discoveries(tests)), ["cls", "encoding"]).where((F.col("step") >= F.col("least_step")) & (F.col("p_random") >= ALPHA))
    more = kept.groupBy("row_id").agg(of_kind(F.collect_list("c").cast(SPAN), 3, KINDS[3]).alias("random"))
    joined = found.join(more, "row_id", "left")
    spans = F.concat("base", F.coalesce("random", F.filter("base", lambda b: F.lit(False))))
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["order"] - b["order"]))
    return joined.select("doc_id", ordered.alias("spans"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["order"] < 3)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(rendered(base), 256).alias("base_sha256"),
        rendered(F.col("spans")).alias("spans"),
    )
