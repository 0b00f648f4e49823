"""Personal data: rule spans that always stay, and further spans that boosted trees pick from generous proposals.

Everything is a Spark expression; the trees are Spark's own gradient boosting.

Rules find e-mail and IP addresses, payment cards and international phone numbers. Generators propose more, also
overlapping one another: digit groups, spelled-out addresses, colon-separated hexadecimal groups, long runs of letters
and digits. Each proposal has format features (lengths, shares of character kinds, group sizes) and context features
(what stands before). Nobody has labelled proposals here, so the trees learn from what the rules are sure of: a
proposal inside a rule span, or after a word such as ``token =``, is positive, and the sign that made it so is left
out of its features. No rule span holds a spelled-out or a colon-separated address, and a corpus can lack signs, so
each generator also has positives built by rule: the corpus's rule e-mails rewritten with "at" and "dot", and
generated addresses, numbers and keys. Negatives are decoys built by rule (dates, amounts, versions, identifiers,
hardware addresses, plain prose). The trees and the thresholds see every positive proposal and every rule e-mail of the
corpus; where there are more than ``max_sample`` and ``n_built`` of them, they weigh as much as so many together, so that
the decoys, whose number is fixed, keep their weight. A threshold is calibrated for each generator
on a held-out part: the smallest score from which the share of positives stays at ``precision`` or more; a generator
without a held-out positive selects nothing.

A selected span that touches a rule span goes; of selected spans that overlap, the one with the best score stays.

Null texts are empty; null and repeated ids each give their row; an empty table gives no rows; other input columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latewise.llm.work import written

# Possessive forms match what the plain ones match, in time linear in the text: after each class comes a character
# outside it. A match begins where its class begins, or where the match before ended.
_LOCAL = r"[A-Za-z0-9._%+-]"
RULES = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What must stand in a text for the rule to find anything.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
GENERATORS = {
    "phone": r"(?<![0-9.])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9.])",
    "email": r"(?i)(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}"
             r"(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63}){0,4}"
             r" ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]{0,60}[0-9])[A-Za-z0-9_-]{20,200}(?![A-Za-z0-9_-])",
}
KINDS = ["email", "ip", "card", "phone", "secret"]
SIGNS = r"(?i)(?:token|secret|password|passwd|api[_ -]?key|access[_ -]?key)[\"' ]*[:=][\"' ]*$"
COUNTRY = r"\+[0-9][0-9 ().-]*$"
WORDS = r"(?i)(?:call|phone|tel|fax|mobile|mail|contact|write|reach)[^A-Za-z]*$"
#: Last parts of addresses, and words that stand before "dot" in prose.
DOMAINS = ["com", "org", "net", "edu", "gov", "info", "biz", "io", "dev", "app", "uk", "de", "fr", "es", "nl", "ch", "eu"]
PROSE = ["the", "this", "that", "every", "one", "a", "each", "his", "her", "its", "my", "your", "our", "their"]
SPAN = "struct<kind:int,start:bigint,end:bigint>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The check sum over digits, from the last to the first."""
    back = F.reverse(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + _doubled(back, i))
    return total % 10 == 0


def _doubled(back: Column, i: Column) -> Column:
    d = F.substr(back, i, F.lit(1)).cast("int")
    return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))


def _part_fits(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+(?=.)", "")
    return (F.length(plain) <= 3) & (F.substr(plain, F.lit(1), F.lit(3)).cast("int") <= 255)


def _valid(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), _part_fits)
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), _luhn(_digits(match))).otherwise(F.lit(False))
    return (n >= 8) & (n <= 15) if kind == "phone" else F.lit(True)


def _located(matches: Column, parts: Column) -> Column:
    """Matches with their place in code points and the text before: parts are what lies around them."""
    both = F.transform(matches, lambda m, i: F.struct(m.alias("match"), F.get(parts, i).alias("before")))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,match:string,left:string>>")
    return F.aggregate(both, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), lambda acc, b: F.struct(
        (acc.at + F.length(b.before) + F.length(b.match)).alias("at"),
        F.concat(acc.out, F.array(F.struct(
            (acc.at + F.length(b.before)).alias("start"),
            (acc.at + F.length(b.before) + F.length(b.match)).alias("end"),
            b.match.alias("match"), F.right(b.before, F.lit(24)).alias("left"),
        ))).alias("out"),
    ), lambda acc: acc.out)


def _search(rows: DataFrame, patterns: dict[str, str], needs: dict[str, str], prefix: str) -> DataFrame:
    """A column of located matches for each pattern."""
    found = {}
    for kind, pattern in patterns.items():
        here = F.when(F.contains("text", F.lit(needs[kind])), F.col("text")).otherwise("") if kind in needs else F.col("text")
        found[f"{prefix}{kind}_m"] = F.regexp_extract_all(here, F.lit(pattern), F.lit(0))
        found[f"{prefix}{kind}_p"] = F.split(here, F.lit(pattern), F.lit(-1))
    rows = rows.withColumns(found)
    return rows.withColumns({
        f"{prefix}{kind}": _located(F.col(f"{prefix}{kind}_m"), F.col(f"{prefix}{kind}_p")) for kind in patterns
    }).drop(*found)


def _share(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")) / F.greatest(F.length(text), F.lit(1))


def features(match: Column, left: Column, generator: Column) -> dict[str, Column]:
    groups = F.filter(F.split(match, "[^0-9A-Za-z]+"), lambda g: g != "")
    sizes = F.transform(groups, F.length)
    return {
        "f_generator": generator.cast("double"), "f_length": F.length(match).cast("double"),
        "f_digits": _share(match, "[^0-9]"), "f_letters": _share(match, "[^A-Za-z]"),
        "f_hex": _share(match, "[^0-9a-fA-F]"), "f_upper": _share(match, "[^A-Z]"),
        "f_groups": F.size(groups).cast("double"), "f_first": F.coalesce(F.get(sizes, F.lit(0)), F.lit(0)).cast("double"),
        "f_second": F.coalesce(F.get(sizes, F.lit(1)), F.lit(0)).cast("double"),
        "f_last": F.coalesce(F.element_at(sizes, -1), F.lit(0)).cast("double"),
        "f_distinct": F.size(F.array_distinct(F.split(F.lower(match), ""))) / F.length(match),
        "f_dashes": _share(match, "[^-]"), "f_dots": _share(match, "[^.]"), "f_brackets": _share(match, r"[^()\[\]]"),
        "f_run": F.array_max(F.transform(F.split(match, "[^a-z]+"), F.length)).cast("double"),
        "f_domain": F.lower(F.element_at(groups, -1)).isin(DOMAINS).cast("double"),
        "f_prose": F.exists(groups, lambda g: F.lower(g).isin(PROSE)).cast("double"),
        "f_word_before": left.rlike(WORDS).cast("double"),
        "f_letter_before": left.rlike(r"[A-Za-z]\W{0,2}$").cast("double"),
        "f_number_before": left.rlike(r"[0-9]\W{0,2}$").cast("double"),
    }


def _rule_spans(kind: str) -> Column:
    code = F.lit(KINDS.index(kind)).alias("kind")
    return F.transform(
        F.filter(f"r_{kind}", lambda s: _valid(kind, s.match)),
        lambda s: F.struct(code, s.start.alias("start"), s.end.alias("end")),
    )


def _proposals(number: int, kind: str) -> Column:
    names = F.lit(number).alias("generator"), F.lit(KINDS.index(kind)).alias("kind")
    return F.transform(f"g_{kind}", lambda s: F.struct(
        *names, s.start.alias("start"), s.end.alias("end"), s.match.alias("match"), s.left.alias("left")))


def propose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, rules, emails, proposals), written: rule spans, the rule e-mails' texts, and what generators match."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = _search(rows, RULES, NEEDS, "r_")
    rules = F.flatten(F.array(*map(_rule_spans, RULES)))
    # What no rule and no generator can match needs no search: all proposals hold a digit or a spelled "at" and "dot".
    emails = F.transform(F.filter("r_email", lambda s: _valid("email", s.match)), lambda s: s.match)
    rows = rows.withColumns({"rules": rules, "emails": emails, "text": F.when(
        F.col("text").rlike(r"[0-9]|(?i:[ (\[]dot[ )\]])"), F.col("text")).otherwise("")})
    rows = _search(rows.select("id", "text", "rules", "emails"), GENERATORS, {}, "g_")
    proposals = F.flatten(F.array(*map(_proposals, range(len(GENERATORS)), GENERATORS)))
    return written(rows.select("id", "rules", "emails", proposals.alias("proposals")).withColumn(
        "row", F.monotonically_increasing_id()))


def _touches(a: Column, b: Column) -> Column:
    return (a.start < b.end) & (b.start < a.end)


def _exploded(proposed: DataFrame) -> DataFrame:
    """One row a proposal: features, whether it touches a rule span, and its weak label."""
    rows = proposed.filter(F.size("proposals") > 0).select("row", "rules", F.explode("proposals").alias("p"))
    inside = F.exists("rules", lambda r: (r.kind == F.col("p.kind")) & (r.start <= F.col("p.start")) & (F.col("p.end") <= r.end))
    # The sign that makes a label is not a feature: what stands before is cut there.
    left = F.regexp_replace(F.regexp_replace(F.col("p.left"), SIGNS, ""), COUNTRY, "")
    return rows.select(
        "row", "p.generator", "p.kind", "p.start", "p.end",
        F.exists("rules", lambda r: _touches(r, F.col("p"))).alias("ruled"),
        (inside | F.col("p.left").rlike(SIGNS)).cast("double").alias("label"),
        F.xxhash64("p.match", "p.left").alias("hash"),
        *(c.alias(n) for n, c in features(F.col("p.match"), left, F.col("p.generator")).items()),
    )


def _number(low: int, high: int, salt: int) -> Column:
    return (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(high - low)) + low).cast("string")


def _hexes(length: int, salt: int) -> Column:
    return F.substr(F.md5(F.concat(F.col("id").cast("string"), F.lit(str(salt)))), F.lit(1), F.lit(length))


def _pick(choices: list[str], salt: int) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), (F.pmod(
        F.xxhash64(F.lit(salt), "id"), F.lit(len(choices))) + 1).cast("int"))


def _kinds(kinds: list[Column]) -> Column:
    """The kind of a row, in turn."""
    return reduce(lambda acc, x: acc.when(F.pmod("id", F.lit(len(kinds))) == x[0], x[1]), enumerate(kinds), F)


def _in_text(found: Column) -> Column:
    """What stands before tells decoys and built positives not apart."""
    return F.concat(_pick(["in the year ", "about ", "see ", "of ", "on "], 9), found, F.lit(" and")).alias("text")


def decoys(spark, n: int) -> DataFrame:
    """Texts that look like proposals and are no personal data."""
    number, hexes = _number, _hexes
    two = lambda low, high, salt: F.lpad(number(low, high, salt), 2, "0")
    day = F.concat_ws("-", number(1950, 2050, 1), two(1, 13, 2), two(1, 29, 3))
    verb = _pick(["look", "stare", "aim", "arrive", "stop", "meet", "laugh"], 21)
    octets = [hexes(2, 30 + i) for i in range(8)]
    small = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.pmod(F.xxhash64(i, "id"), F.lit(60)))
    kinds = [
        F.concat_ws(" ", day, F.concat_ws(":", two(0, 24, 4), two(0, 60, 5), two(0, 60, 6))),
        F.concat_ws(" ", number(1, 999, 1), number(100, 999, 2), number(100, 999, 3)),
        F.concat_ws(".", number(0, 30, 1), number(0, 400, 2), number(0, 4000, 3)),
        F.concat_ws("-", F.lit("978"), number(0, 9, 1), number(1000, 9999, 2), number(1000, 9999, 3)),
        F.concat_ws("-", number(1500, 2050, 1), number(1500, 2050, 2), number(1500, 2050, 3)),
        F.concat_ws(":", two(0, 24, 4), two(0, 60, 5), two(0, 60, 6), two(0, 60, 7)),
        F.concat_ws(" ", F.lit("look"), F.lit("at"), hexes(5, 1), F.lit("dot"), F.lit("point")),
        F.concat_ws("-", F.lit("a-very-long-chapter-name"), number(1, 99, 1), F.lit("of-this-book")),
        F.concat_ws("_", F.lit("some_function_name_version"), number(1, 99, 1)),
        F.concat_ws(" ", number(10, 99, 1), number(1000, 9999, 2), number(1000, 9999, 3), number(10, 99, 4)),
        F.concat_ws(" ", verb, F.lit("at"), _pick(PROSE, 22), F.lit("dot"), _pick(
            ["on", "in", "of", "for", "near", "com", "and", "above", "under", "where"], 23)),
        F.concat_ws(" ", verb, F.lit("at"), _pick(["noon", "home", "work", "school", "dawn", "night", "sea"], 22),
                    F.lit("dot"), _pick(["then", "we", "they", "line", "mark", "here", "after", "he", "she", "it"], 23)),
        F.concat_ws(":", *octets[:6]), F.concat_ws(":", *octets),
        F.array_join(F.slice(small.cast("array<string>"), F.lit(1), number(5, 8, 24).cast("int")), ":"),
    ]
    return spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), _in_text(_kinds(kinds)))


def built(spark, n: int) -> DataFrame:
    """(doc_id, text): personal data that no rule and no sign labels; the id is the generator that is to find it."""
    number, hexes = _number, _hexes
    own = F.floor(F.col("id") / len(GENERATORS))
    last = F.lpad(number(0, 10_000, 3), 4, "0")
    phone = _kinds([
        F.concat(F.lit("("), number(100, 1000, 1), F.lit(") "), number(200, 1000, 2), F.lit("-"), last),
        F.concat_ws("-", number(200, 1000, 1), number(200, 1000, 2), last),
    ])
    local = F.concat(_pick(["john", "anna", "m.weber", "info", "li", "sales", "j_smith", "k-olsen"], 1), F.when(
        F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(2)) == 0, number(1, 1000, 3)).otherwise(""))
    host = F.concat(_pick(["example", "mail", "acme", "uni-bonn", "web", "northwind"], 4), F.when(
        F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(3)) == 0, number(1, 100, 6)).otherwise(""))
    spelled = F.concat(
        local, _pick([" at ", " at ", "(at)", " (at) ", "[at]", " [at] "], 7), host,
        F.when(F.pmod(F.xxhash64(F.lit(8), "id"), F.lit(4)) == 0, F.concat(F.lit(" dot "), hexes(5, 10))).otherwise(""),
        _pick([" dot ", " dot ", "(dot)", " (dot) ", "[dot]", " [dot] "], 7), _pick(DOMAINS, 11))
    # Groups have no leading zeros, and short ones, zero among them, are as frequent as long ones.
    groups = [F.hex(F.pmod(F.xxhash64(F.lit(40 + i), "id"), F.element_at(F.array(*map(F.lit, (1, 16, 256, 4096, 65_536))), (
        F.pmod(F.xxhash64(F.lit(50 + i), "id"), F.lit(5)) + 1).cast("int")))) for i in range(7)]
    first = F.hex(F.pmod(F.xxhash64(F.lit(60), "id"), F.lit(0xF000)) + 0x1000)
    full = [F.lpad(g, 4, "0") for g in groups]
    six = F.concat_ws(":", F.when(own % 2 == 0, F.lit("2001")).otherwise(first), F.when(
        own % 4 == 0, F.concat_ws(":", *full)).otherwise(F.concat_ws(":", *groups)))
    key = F.sha1(F.concat(F.lit("key"), F.col("id").cast("string")))
    mixed = F.regexp_replace(F.base64(F.unhex(F.sha2(key, 256))), "[^A-Za-z0-9]", "")
    found = {"phone": phone, "email": spelled, "ip": F.when(own % 3 == 0, six).otherwise(F.lower(six)), "secret": F.when(
        own % 2 == 0, key).otherwise(F.substr(mixed, F.lit(1), number(24, 40, 12).cast("int")))}
    text = _kinds([found[kind] for kind in GENERATORS])
    return spark.range(n).select(F.pmod("id", F.lit(len(GENERATORS))).alias("doc_id"), _in_text(text))


def spelled_out(proposed: DataFrame) -> DataFrame:
    """(doc_id, text) as from ``built``: all rule e-mails of the corpus, spelled out."""
    emails = proposed.select(F.explode("emails").alias("email")).distinct().withColumn("id", F.xxhash64("email"))
    at, dot = (_pick([f" {x} ", f" {x} ", f"({x})", f" [{x}] "], 7) for x in ("at", "dot"))
    parts = F.split("email", "@")
    return emails.select(F.lit(list(GENERATORS).index("email")).cast("long").alias("doc_id"), _in_text(F.concat(
        F.get(parts, F.lit(0)), at, F.replace(F.get(parts, F.lit(1)), F.lit("."), dot))))


#: The names that features() gives, in order.
FEATURES = [
    "f_generator", "f_length", "f_digits", "f_letters", "f_hex", "f_upper", "f_groups", "f_first", "f_second", "f_last",
    "f_distinct", "f_dashes", "f_dots", "f_brackets", "f_run", "f_domain", "f_prose", "f_word_before", "f_letter_before", "f_number_before",
]


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_sample: int = 20_000, n_decoys: int = 4_000,
    precision: float = 0.98, trees: int = 12, depth: int = 4, n_built: int = 4_000,
) -> DataFrame:
    """(id, rules, added): rule spans and selected further spans, as (kind, start, end) in code points."""
    proposed = propose(docs, id_col, text_col)
    candidates = _exploded(proposed)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    sample = candidates.filter("label = 1").drop("row")
    negative = _exploded(propose(decoys(docs.sparkSession, n_decoys))).withColumn("label", F.lit(0.0)).drop("row")

    def positive(texts: DataFrame) -> DataFrame:
        made = propose(texts)
        own = _exploded(made.withColumn("proposals", F.filter("proposals", lambda p: p.generator == F.col("id"))))
        return own.withColumn("label", F.lit(1.0)).drop("row")

    parts = {"corpus": sample, "decoys": negative, "built": positive(built(docs.sparkSession, n_built)), "emails": positive(spelled_out(proposed))}
    parts = [t.select("generator", "label", "hash", *FEATURES, F.lit(name).alias("part")) for name, t in parts.items()]
    learned = written(vectors.transform(reduce(DataFrame.unionByName, parts)))
    sizes = {r["part"]: r["count"] for r in learned.groupBy("part").count().collect()}
    weights = {part: min(1.0, most / max(1, sizes.get(part, 0))) for part, most in (("corpus", max_sample), ("emails", n_built))}
    weight = reduce(lambda w, part: w.when(F.col("part") == part, weights[part]), weights, F.when(F.lit(False), 1.0)).otherwise(1.0)
    learned = learned.withColumn("weight", weight)
    held = F.pmod(F.xxhash64(F.lit(1), "hash"), F.lit(4)) == 0
    nothing = F.array().cast(f"array<{SPAN}>")
    if learned.filter(~held).select("label").distinct().count() < 2:
        return proposed.select("id", "rules", nothing.alias("added"))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=5, stepSize=0.3, weightCol="weight").fit(learned.filter(~held))
    score = vector_to_array("probability")[1]
    limits = _thresholds(model.transform(learned.filter(held)).withColumn("score", score), precision)
    chosen = (
        model.transform(vectors.transform(candidates.filter("not ruled"))).withColumn("score", score)
        .join(limits, "generator").filter(F.col("score") >= F.col("least"))
        .groupBy("row").agg(F.collect_list(F.struct((-F.col("score")).alias("rank"), "start", "end", "kind")).alias("c"))
    )
    best = F.aggregate(F.array_sort("c"), F.array().cast(f"array<{SPAN}>"), lambda kept, s: F.when(
        F.exists(kept, lambda k: _touches(k, s)), kept
    ).otherwise(F.concat(kept, F.array(_plain(s)))))
    return proposed.join(chosen.select("row", best.alias("added")), "row", "left").select(
        "id", "rules", F.coalesce("added", nothing).alias("added"))


def _plain(s: Column) -> Column:
    return F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"))


def _thresholds(scored: DataFrame, precision: float) -> DataFrame:
    """(generator, least): the smallest score from which positives make up ``precision`` by weight.

    Equal scores are added up first; trees give few different ones, so no window sees the rows.
    """
    ends = scored.groupBy("generator", "score").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("label")).alias("p"))
    down = Window.partitionBy("generator").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    share = ends.withColumn("share", F.sum("p").over(down) / F.sum("w").over(down))
    return share.filter((F.col("share") >= precision) & (F.col("p") > 0)).groupBy("generator").agg(F.min("score").alias("least"))


def as_text(spans: Column) -> Column:
    """kind:start:end by kind, then start, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[removed]") -> Column:
    """The text with every span, overlapping ones together, replaced by the mark."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"))))
    done = F.aggregate(ordered, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), lambda acc, s: F.struct(
        F.greatest(acc.at, s.end).alias("at"),
        F.when(s.start >= acc.at, F.concat(
            acc.out, F.substr(text, (acc.at + 1).cast("int"), (s.start - acc.at).cast("int")), F.lit(mark)
        )).otherwise(acc.out).alias("out"),
    ))
    return F.concat(done.out, F.substr(text, (done.at + 1).cast("int"), F.length(text)))
