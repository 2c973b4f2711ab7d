"""Personal data: patterns, and bootstrapped contextual extraction. DataFrame functions only.

The patterns' finds are seeds. A lexical context is the two words before an identifier, the first
of which may be the start of the text; contexts and identifiers form a
graph that Spark scores in turns: a context is as trustworthy, for a kind, as the share of its identifiers that belong
to that kind (with one doubtful identifier added); an unseen identifier is as likely as the chance that at least one of
its contexts is right. After ROUNDS turns, identifiers that reach THRESHOLD for a kind are reported as `context_<kind>`
wherever they stand, with or without a context.
Only tokens with several digits that the patterns don't cover may be discovered.

Defined results: a null or empty text has no spans. Each distinct identifier counts once for a context, so copies of a
text add nothing. Ties in score go to the kind listed first. Extra columns are ignored. An empty table gives an empty
result. Contexts shared by many rows are joined with salted keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import matches, of_kind, rendered, uncovered
from .textops import checkpoint, quoted, table

KINDS = ("email", "ip", "card", "phone")
# The patterns of the contract. Possessive quantifiers and boundaries only keep the search linear: a match
# can start inside a run of its own first characters only right after another match (\G).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What may be discovered: a token of letters, digits and joining marks with at least four digits.
CANDIDATE = r"(?<![A-Za-z0-9#/_.-])(?=[A-Za-z#/_.-]*+[0-9](?:[A-Za-z#/_.-]*+[0-9]){3})[A-Za-z0-9#][A-Za-z0-9#/_.-]*[A-Za-z0-9]"
CONTEXT = 64  # code points looked at before an identifier
ROUNDS = 3
THRESHOLD = 0.6
SUPPORT = 3  # distinct seeds that a context needs
SALTS = 16


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the last digit checks the ones before it."""
    places = F.split(F.reverse(digits), "")
    state = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("twice"))

    def step(acc: Column, c: Column) -> Column:
        d = F.instr(F.lit("0123456789"), c) - 1
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((acc["sum"] + F.when(acc["twice"], twice).otherwise(d)).alias("sum"), (~acc["twice"]).alias("twice"))

    return F.aggregate(F.filter(places, lambda c: c != ""), state, step, lambda acc: acc["sum"] % 10 == 0)


def base_spans(text: Column) -> dict[str, Column]:
    digit = text.rlike("[0-9]")
    email = matches(text, EMAIL, F.contains(text, F.lit("@")), CONTEXT)
    ip = matches(text, IP, digit, CONTEXT)
    card = matches(text, CARD, digit, CONTEXT)
    phone = matches(text, PHONE, F.contains(text, F.lit("+")), CONTEXT)
    part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    fits = lambda s, least, most: F.length(_digits(s["value"])).between(least, most)
    return {
        "email": email,
        "ip": F.filter(ip, lambda s: s["value"].rlike(rf"^(?:{part}|0+)(?:\.(?:{part}|0+)){{3}}$")),
        "card": F.filter(card, lambda s: F.when(fits(s, 13, 19), luhn(_digits(s["value"]))).otherwise(False)),
        "phone": F.filter(phone, lambda s: fits(s, 9, 15)),
    }


def _context(before: Column) -> Column:
    """The last two words ahead, in lower case, with digits masked; ^ stands for the start of the text, and nothing but that
    is no context (empty)."""
    ahead = F.when(F.length(before) < CONTEXT, F.concat(F.lit("^ "), before)).otherwise(before)
    words = F.regexp_extract(ahead, r"(\S+\s+\S+)\s*$", 1)
    return F.regexp_replace(F.regexp_replace(F.lower(words), r"[0-9]+", "0"), r"\s+", " ")


def salted_join(large: DataFrame, small: DataFrame, key: str, spread: str) -> DataFrame:
    """Inner join on `key`, of which `large` may have very many rows alike: they are dealt over SALTS parts by `spread`,
    and each row of `small` goes to every part."""
    left = large.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    right = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("long"))
    return left.join(right, [key, "salt"]).drop("salt")


def discover(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Score the graph. edges: distinct (context, identifier, kind or null); gives unseen identifiers with kind and score."""
    known = edges.where("kind is not null").select("context", "identifier", "kind", F.lit(1.0).alias("score"))
    # Contexts that too few seeds share can never be trusted: leave them out of the graph for good.
    supported = known.groupBy("context").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= SUPPORT).select("context")
    edges = checkpoint(salted_join(edges, supported, "context", "identifier"))
    degree = edges.groupBy("context").agg(F.count("*").alias("degree"))
    unseen = edges.where("kind is null").select("context", "identifier")
    known = edges.where("kind is not null").select("context", "identifier", "kind", F.lit(1.0).alias("score"))
    guesses = known.select("identifier", "kind", "score").limit(0)
    for _ in range(rounds):
        told = known.unionByName(salted_join(unseen, guesses, "identifier", "context").select("context", "identifier", "kind", "score"))
        trust = told.groupBy("context", "kind").agg(F.sum("score").alias("sum")).join(degree, "context")
        trust = trust.select("context", "kind", (F.col("sum") / (F.col("degree") + 1)).alias("trust"))
        reached = salted_join(unseen, trust, "context", "identifier")
        doubt = F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9))))
        guesses = checkpoint(reached.groupBy("identifier", "kind").agg((1 - F.exp(doubt)).alias("score")))
    return guesses


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans (order, kind, start, stop, value) by kind as listed, then start; discovered ones come last."""
    t = F.coalesce(quoted(text).cast("string"), F.lit(""))
    base = base_spans(t)
    found = docs.select(
        quoted(id_column).alias("doc_id"),
        F.concat(*[of_kind(base[k], i, k) for i, k in enumerate(KINDS)]).alias("base"),
        matches(t, CANDIDATE, t.rlike("[0-9]"), CONTEXT).alias("candidates"),
    ).withColumn("candidates", uncovered(F.col("candidates"), F.col("base")))
    found = checkpoint(found.withColumn("row_id", F.monotonically_increasing_id()))
    free = found.select("row_id", F.explode("candidates").alias("c"))
    free = free.select("row_id", "c", _context(F.col("c.before")).alias("context"), F.lower("c.value").alias("identifier"))
    seeds = found.select(F.explode("base").alias("b")).select(_context(F.col("b.before")).alias("context"), F.lower("b.value").alias("identifier"), F.col("b.kind").alias("kind")).where("context <> ''")
    edges = seeds.unionByName(free.where("context <> ''").select("context", "identifier", F.lit(None).cast("string").alias("kind"))).groupBy("context", "identifier", "kind").agg(F.count("*").alias("n")).drop("n")
    guesses = discover(edges).where(F.col("score") >= THRESHOLD)
    best = guesses.groupBy("identifier").agg(F.max_by("kind", F.struct("score", *[F.col("kind") == k for k in KINDS])).alias("kind"))
    hits = salted_join(free.select("row_id", "c", "identifier"), best, "identifier", "row_id")
    spans = hits.groupBy("row_id").agg(F.collect_list(F.struct(F.col("c"), F.concat(F.lit("context_"), F.col("kind")).alias("kind"))).alias("more"))
    more = F.transform("more", lambda m: F.struct(F.lit(len(KINDS)).alias("order"), m["kind"].alias("kind"), m["c"]["start"].alias("start"), m["c"]["stop"].alias("stop"), m["c"]["value"].alias("value"), m["c"]["before"].alias("before")))
    joined = found.join(spans, "row_id", "left").select("doc_id", F.concat("base", F.coalesce(more, F.filter("base", lambda b: F.lit(False)))).alias("spans"))
    ordered = F.array_sort("spans", lambda a, b: F.when(a["order"] != b["order"], a["order"] - b["order"]).otherwise(a["start"] - b["start"]))
    return joined.select("doc_id", ordered.alias("spans"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["order"] < len(KINDS))
    count = lambda i: F.size(F.filter("spans", lambda s: s["order"] == i)).cast("long")
    return out.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        count(len(KINDS)).alias("n_context"),
        F.sha2(rendered(base), 256).alias("base_sha256"),
        rendered(F.col("spans")).alias("spans"),
    )
