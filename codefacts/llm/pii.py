"""Personal data by patterns and by bootstrapped contexts, in DataFrame functions only.

Base matches of four kinds (email, ip, card, phone) are taken from every whole text, with their places. They are the seed
entities, and so are secrets that cannot be taken for anything else (hexadecimal digests), which are no base matches and are
reported only where a pattern finds them. The words around seeds induce lexical patterns (two words before, one before and one after, or one before),
without case, punctuation around words and values of digits. Patterns and
the tokens they surround form a graph that is scored in rounds: a pattern is trusted for a kind by the share of its
tokens that are believed to be of that kind, a token is believed by the patterns that surround it. Patterns that end up
trusted, however many, then discover tokens that the base patterns miss, if they look like the kind at all. Base matches
always stay.

Null and empty texts have no matches. Texts of any length are read whole; places count code points, the end excluded.
Matches of one kind never overlap; those of different kinds may, and all count. Repeated rows are judged each. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.functions.arrays import place, sums_before
from codefacts.functions.skew import salted_join
from codefacts.session import materialize

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Possessive quantifiers and the looks behind change no match; they keep the time linear.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# End of fixed values.
#: a token that may be an identifier: it has a digit or an @
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: kinds beyond the base: what a token must be to be a seed of it
SEEDS = {"secret": r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"}
#: what a discovered token must look like
LOOKS = {"secret": r"^[A-Za-z0-9+/=_.~-]{16,}$", "email": r"^\S+@\S+$", "ip": r"^\S*[0-9]+\.[0-9]+\.\S*$", "card": r"^(?:\D*[0-9]){12}", "phone": r"^(?:\D*[0-9]){7}"}
#: characters before and after a token in which its words are looked for first; longer words are then read whole
NEAR = 64
#: seeds that a pattern needs; share from which it is trusted
SUPPORT, TRUST = 5, 0.8
#: rounds after which scoring that has not settled is an error
MOST_ROUNDS = 200


def _with_places(df: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """Adds ``name``: an array of (start, end, value, before, after) of all matches; before and after are nearby text."""
    some = F.regexp_like(text, F.lit(pattern))
    df = df.withColumn("__v", F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("__p", F.when(F.size("__v") > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("__l", F.zip_with("__v", F.slice("__p", F.lit(1), F.size("__v")), lambda v, p: (F.char_length(v) + F.char_length(p)).cast("long")))
    df = df.withColumn("__s", sums_before(F.col("__l")))

    def match(v: Column, i: Column) -> Column:
        before, after = F.get("__p", i), F.get("__p", i + 1)
        start = F.get("__s", i) + F.char_length(before)
        # what is near may begin before the match before, and end after the next one
        last = lambda c: F.coalesce(F.substring(c, -NEAR, NEAR), F.lit(""))
        head = lambda c: F.coalesce(F.substring(c, 1, NEAR), F.lit(""))
        near = last(F.concat(last(F.get("__p", i - 1)), last(F.get("__v", i - 1)), last(before)))
        next_ = head(F.concat(head(after), head(F.get("__v", i + 1)), head(F.get("__p", i + 2))))
        # where a word reaches the end of what was looked at, the pieces are taken whole; all of them together are a few times the text
        whole = lambda *parts: F.concat(*[F.coalesce(x, F.lit("")) for x in parts])
        all_before = whole(F.get("__p", i - 2), F.get("__v", i - 2), F.get("__p", i - 1), F.get("__v", i - 1), before)
        all_after = whole(after, F.get("__v", i + 1), F.get("__p", i + 2), F.get("__v", i + 2), F.get("__p", i + 3))
        near = F.when(F.regexp_like(near, F.lit(r"\s\S+\s+\S+\s*$")), near).otherwise(all_before)
        next_ = F.when(F.regexp_like(next_, F.lit(r"^\s*\S+\s")), next_).otherwise(all_after)
        return F.struct(start.alias("start"), (start + F.char_length(v)).alias("end"), v.alias("value"), near.alias("before"), next_.alias("after"))

    return df.withColumn(name, F.transform("__v", match)).drop("__v", "__p", "__l", "__s")


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    if kind == "ip":
        return F.regexp_like(value, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    if kind == "card":
        return F.when(digits.between(13, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return digits.between(9, 15)
    return F.lit(True)


def _test(kind: str):
    return lambda m: _valid(kind, m["value"])


def base_matches(docs: DataFrame) -> DataFrame:
    """doc_id, text and for each kind an array of (start, end, value, before, after)."""
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    for kind in KINDS:
        df = _with_places(df, "text", BASE[kind], f"{kind}_all")
        df = df.withColumn(kind, F.filter(f"{kind}_all", _test(kind))).drop(f"{kind}_all")
    return df


def _bare(token: Column) -> Column:
    """A token without punctuation around it."""
    return F.regexp_replace(token, r"^[^\p{L}\p{N}+@]+|[^\p{L}\p{N}]+$", "")


def _plain(words: Column) -> Column:
    """Words of a context: one space between them, digits as 0, without punctuation around them unless they are nothing else."""
    bare = F.regexp_replace(words, r"(?<!\S)[^\p{L}\p{N}\s]+(?=[\p{L}\p{N}])|(?<=[\p{L}\p{N}])[^\p{L}\p{N}\s]+(?!\S)", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"\p{Nd}+", "0")


def _contexts(m: Column) -> Column:
    """The patterns that surround a token: two words before, one before and one after, one before; an array of up to three."""
    before, after = F.lower(m["before"]), F.lower(m["after"])
    two = F.regexp_extract(before, r"(?:^|\s)(\S+\s+\S+)\s*$", 1)
    one, next_ = F.regexp_extract(before, r"(?:^|\s)(\S+)\s*$", 1), F.regexp_extract(after, r"^\s*(\S+)(?:\s|$)", 1)
    return F.filter(
        F.array(
            F.when(two != "", F.concat(F.lit("2 "), _plain(two))),
            F.when((one != "") & (next_ != ""), F.concat(F.lit("1 "), _plain(one), F.lit(" _ "), _plain(next_))),
            F.when(one != "", F.concat(F.lit("0 "), _plain(one))),
        ),
        lambda c: c.isNotNull(),
    )


def _seed_kind(value: Column) -> Column:
    """The kind beyond the base that a token is a seed of, else null."""
    out = F.lit(None).cast("string")
    for kind, pattern in SEEDS.items():
        out = F.when(F.regexp_like(value, F.lit(pattern)), kind).otherwise(out)
    return out


def _with_candidates(df: DataFrame) -> DataFrame:
    """Adds ``tokens`` (start, end, value, patterns, kind) that no base match touches, and ``seeds`` (kind, value, patterns).

    The kind of a token is null unless it is a seed of a kind beyond the base.
    """
    df = _with_places(df, "text", TOKEN, "tokens_all")

    def free(t: Column) -> Column:
        out = F.lit(True)
        for k in KINDS:  # the first match of a kind that ends after the token's start must not begin before its end
            first = F.get(F.col(f"{k}.start"), place(F.col(f"{k}.end"), t["start"] + 1))
            out = out & (F.coalesce(first, t["end"]) >= t["end"])
        return out

    tokens = F.transform(
        F.filter("tokens_all", free),
        lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value"), _contexts(t).alias("patterns"), _seed_kind(_bare(t["value"])).alias("kind")),
    )
    seed = lambda k: lambda m: F.struct(F.lit(k).alias("kind"), m["value"].alias("value"), _contexts(m).alias("patterns"))
    seeds = F.concat(*[F.transform(k, seed(k)) for k in KINDS])
    return df.withColumn("tokens", tokens).withColumn("seeds", seeds).drop("tokens_all")


def evidence(docs: DataFrame) -> DataFrame:
    """row, doc_id, base matches by kind, tokens that may be identifiers, seeds; written once, so that texts are read once.

    Reading it back also keeps filters on what is exploded from being pushed into the regular expressions.
    """
    rows = _with_candidates(base_matches(docs))
    bare = [F.transform(k, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"))).alias(k) for k in KINDS]
    return materialize(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", *bare, "tokens", "seeds"))


def graph(rows: DataFrame) -> DataFrame:
    """Edges of the pattern-instance graph: pattern, instance, kind (of seeds, else null) and n."""
    seeds = rows.select(F.explode("seeds").alias("e")).select("e.kind", F.lower("e.value").alias("instance"), "e.patterns")
    others = rows.select(F.explode("tokens").alias("e")).select("e.kind", F.lower(_bare(F.col("e.value"))).alias("instance"), "e.patterns")
    both = seeds.unionByName(others).filter("instance <> ''")
    return both.select("kind", "instance", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance", "kind").agg(F.count("*").alias("n"))


def trusted_patterns(edges: DataFrame) -> DataFrame:
    """pattern, kind, trust and quality of all patterns that are trusted when a round of scoring changes no set of them any more."""
    believed = edges.select("pattern", "instance", "kind", F.col("kind").isNotNull().cast("double").alias("belief"))
    known: set = set()
    while True:
        whole = believed.groupBy("pattern").agg(F.countDistinct("instance").alias("instances"))
        part = believed.filter("belief > 0").groupBy("pattern", "kind").agg(F.sum("belief").alias("belief"), F.countDistinct("instance").alias("support"))
        part = part.filter(F.col("support") >= SUPPORT)
        trust = F.col("belief") / F.col("instances")
        scored = part.join(whole, "pattern").select("pattern", "kind", "support", trust.alias("trust")).filter(F.col("trust") >= TRUST)
        trusted = materialize(scored.select("pattern", "kind", "trust", (F.col("trust") * F.log2("support")).alias("quality")))
        now = trusted.agg(F.count("*").alias("n"), F.sum(F.xxhash64("pattern", "kind").cast("decimal(38,0)")).alias("h")).first()
        if not now.n or now in known:  # settled, or the same sets come round again
            return trusted
        if len(known) == MOST_ROUNDS:
            raise RuntimeError("the trusted patterns do not settle")
        known.add(now)
        # a token without a kind is believed by the trusted patterns around it: one minus the product of their doubts
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("trust")))))
        others = edges.filter("kind is null").select("pattern", "instance")
        new = salted_join(others, trusted.drop("quality"), ["pattern"], ["instance"]).groupBy("instance", "kind").agg((1 - doubt).alias("belief"))
        new = others.join(new, "instance", "left").select("pattern", "instance", "kind", F.coalesce("belief", F.lit(0.0)).alias("belief"))
        seeds = edges.filter("kind is not null").select("pattern", "instance", "kind", F.lit(1.0).alias("belief"))
        believed = materialize(seeds.unionByName(new))


def _looks(kind: Column, value: Column) -> Column:
    out = F.lit(False)
    for k, looks in LOOKS.items():
        out = F.when(kind == k, F.regexp_like(value, F.lit(looks))).otherwise(out)
    return out


def discovered(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """row and ``found`` (kind, start, end, value) of the rows in which trusted patterns discover tokens.

    Of several patterns around a token the first counts, of several kinds of a pattern the best.
    """
    best = patterns.groupBy("pattern").agg(F.min_by("kind", F.struct(-F.col("quality"), F.col("kind"))).alias("kind"))
    tokens = rows.select("row", F.explode("tokens").alias("t"))
    any_look = F.lit(False)
    bare = _bare(F.col("t.value"))
    for looks in LOOKS.values():
        any_look = any_look | F.regexp_like(bare, F.lit(looks))
    places = tokens.filter(any_look).select("row", "t.start", "t.value", F.posexplode("t.patterns").alias("nth", "pattern"))
    met = salted_join(places, best, ["pattern"], ["row", "start"]).groupBy("row", "start").agg(F.min_by("kind", "nth").alias("kind"), F.first("value").alias("token"))
    inner = _bare(F.col("token"))
    start = F.col("start") + F.char_length(F.regexp_extract("token", r"^[^\p{L}\p{N}+@]+", 0))
    judged = met.select("row", "kind", start.alias("start"), (start + F.char_length(inner)).alias("end"), inner.alias("value")).filter(_looks(F.col("kind"), F.col("value")))
    one = F.struct("start", "kind", "end", "value")
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
    return judged.groupBy("row").agg(listed.alias("found"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id; ``email``, ``ip``, ``card``, ``phone``: arrays of base matches (start, end, value); ``found``: discovered (kind, start, end, value)."""
    rows = evidence(docs)
    patterns = trusted_patterns(materialize(graph(rows)))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>")
    if patterns.isEmpty():
        return rows.select("doc_id", *KINDS, none.alias("found"))
    found = materialize(discovered(rows, patterns))
    return rows.drop("tokens", "seeds").join(found, "row", "left").select("doc_id", *KINDS, F.coalesce("found", none).alias("found"))


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda m: F.concat_ws(":", F.lit(kind), m["start"].cast("string"), m["end"].cast("string")))


def span_texts(found: DataFrame) -> DataFrame:
    """doc_id, counts of base matches and of discovered ones, ``base`` and ``spans``: kind:start:end by kind and start, joined by commas.

    Kinds beyond the base come after those of the base.
    """
    base = F.array_join(F.concat(*[_listed(k, F.col(k)) for k in KINDS]), ",")
    span = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))
    of_kind = lambda k: lambda m: m["kind"] == k
    merged = [_listed(k, F.array_sort(F.concat(F.transform(k, span), F.transform(F.filter("found", of_kind(k)), span)))) for k in KINDS]
    merged += [_listed(k, F.array_sort(F.transform(F.filter("found", of_kind(k)), span))) for k in SEEDS]
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS] + [F.size("found").cast("long").alias("n_found")]
    return found.select("doc_id", *counts, base.alias("base"), F.array_join(F.concat(*merged), ",").alias("spans"))
