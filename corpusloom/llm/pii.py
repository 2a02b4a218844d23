"""Personal data by weak supervision, in DataFrame operations only.

Candidate spans come from patterns.  Three labelers vote on each: its own form
(regex), a table of known values that it is joined to (gazetteer), and the words before
it and personal data beside it (context).  Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is; a logistic span classifier is trained on
the resulting soft labels.  Valid spans of the four base kinds always stand, and anchor what
label 1 means; of the other candidates (long digit runs that fail the card rule, which speaks against them, numbers
after a cue, names, places, local and social security numbers, spelled-out addresses)
those that some labeler speaks for and the classifier accepts are added.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm import gazetteer
from corpusloom.llm.common import broadcast_if_light, checkpointed, table, text_key

_CITY, _GIVEN = "|".join(gazetteer.CITIES), "|".join(gazetteer.GIVEN_NAMES)
_NUMBER_CUES = "phone|tel|call|fax|mobile|cell|account|iban|passport|licen[cs]e|customer|card|konto|telefon|handy|ausweis|compte|carte|cuenta|tarjeta"
#: Kinds in the order of the output; the first four are the base kinds.  The possessive forms
#: and look-behinds match what the plain patterns match, without backtracking over long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "number": rf"(?<![0-9A-Za-z.+-])(?<![0-9+] )[0-9](?:[ -]?[0-9]){{12,18}}+(?![0-9A-Za-z])|(?<=\b(?i:{_NUMBER_CUES})(?:[ .:#]|: |\. ))[0-9](?:[ -]?[0-9]){{6,11}}+(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9+.-])(?<![0-9] )[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local": r"(?<![0-9A-Za-z+().-])(?<![0-9+][ ])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "spelled": r"(?<![A-Za-z0-9])[A-Za-z0-9._-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63}){1,8}",
    "name": rf"(?<![A-Za-z])(?=[A-Z])(?:{_GIVEN}) [A-Z][a-z]+(?![A-Za-z])",
    "place": rf"(?<![A-Za-z])(?=[A-Z])(?:{_CITY})(?![A-Za-z])",
}
BASE = ("email", "ip", "card", "phone")
#: A cheap condition that any match implies.
IMPLIED = {
    "email": ("contains", "@"),
    "ip": ("rlike", r"[0-9]\.[0-9]"),
    "card": ("rlike", r"[0-9](?:[ -]?[0-9]){12}"),
    "phone": ("contains", "+"),
    "number": ("rlike", "[0-9](?:[ -]?[0-9]){6}"),
    "ssn": ("rlike", r"[0-9]-[0-9]{2}-[0-9]"),
    "local": ("rlike", r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
    "spelled": ("rlike", r"[\[(]at[\])]"),
    "name": ("rlike", "[A-Z][a-z]+ [A-Z][a-z]"),
    "place": ("rlike", f"(?=[A-Z])(?:{_CITY})"),
}
#: Words before a span that speak for its kind, and those that speak against any.
CUES = {
    "email": "mail|contact|write to|reach",
    "ip": r"\bip\b|host|server|address|login",
    "card": "card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobile|cell|whatsapp|handy|appel|llama",
    "number": _NUMBER_CUES,
    "ssn": "ssn|social security",
    "local": "phone|tel|call|fax|mobile|cell|whatsapp",
    "spelled": "mail|contact|write to|reach",
    "name": r"\b(?:name|mr|mrs|ms|dr|dear|by|contact|herr|frau|monsieur|madame|se[nñ]ora?)\b",
    "place": r"\b(?:lives? in|living in|born in|address|resident of|wohnt in|wohnhaft in|habite|vive en|nacid[oa] en)\b",
}
AGAINST = r"version|isbn|issn|order|invoice|serial|build|release|checksum"
#: A valid base span no farther away than this speaks for a span, too.
NEAR = 40

#: Rounds of expectation-maximisation and of the classifier's gradient steps.
EM_ROUNDS, FIT_ROUNDS = 60, 400
LABELERS = ("form", "listed", "context")
#: Texts and spans of texts (about 30 bytes each) up to so many are broadcast to the documents; more are joined by shuffle.
BROADCAST_SPANS = 500_000


def _candidates_of(kind: str) -> Column:
    """Of the column ``text``: each match with the length of the text since the last and what stands before it."""
    pieces, found = F.col(f"__{kind}_pieces"), F.col(f"__{kind}_found")
    return F.transform(
        found,
        lambda m, i: F.struct(
            F.lit(list(PATTERNS).index(kind)).alias("kind"),
            i.alias("at"),
            F.length(F.get(pieces, i)).alias("gap"),
            m.alias("match"),
            F.lower(F.substring(F.get(pieces, i), -40, 40)).alias("before"),
        ),
    )


def _exploded(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*text_key("text"), text.alias("text"))
    for kind, pattern in PATTERNS.items():
        how, what = IMPLIED[kind]
        may = getattr(F.col("text"), how)(what)
        rows = rows.withColumn(f"__{kind}_found", F.when(may, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    for kind, pattern in PATTERNS.items():
        some = F.size(f"__{kind}_found") > 0
        rows = rows.withColumn(f"__{kind}_pieces", F.when(some, F.split("text", pattern, -1)))
    every = F.concat(*[_candidates_of(kind) for kind in PATTERNS])
    # outer: a plain explode would have the optimiser test the array's size, and with it run every pattern, once more below
    return rows.select("key1", "key2", F.explode_outer(every).alias("c")).filter("c IS NOT NULL").select("key1", "key2", "c.*")


def _digits(column: str = "match") -> Column:
    return F.regexp_replace(column, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check sum of a run of 13 to 19 digits holds."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _per_kind(of: dict[str, Column], otherwise) -> Column:
    column = otherwise
    for kind, value in of.items():
        column = F.when(F.col("kind") == list(PATTERNS).index(kind), value).otherwise(column)
    return column


def _vote(condition: Column, yes: int = 1, no: int = 0) -> Column:
    return F.when(condition, yes).otherwise(no)


def _valid() -> Column:
    """The rule of the base kinds; false for others."""
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    n = F.length(_digits())
    return _per_kind(
        {
            "email": F.lit(True),
            "ip": F.col("match").rlike(rf"^{part}(?:\.{part}){{3}}$"),
            "card": n.between(13, 19) & F.when(n.between(13, 19), _luhn(_digits())).otherwise(False),
            "phone": n.between(9, 15),
        },
        F.lit(False),
    )


def _form() -> Column:
    """The vote of a span's own form."""
    n = F.length(_digits())
    return _per_kind(
        {
            **{k: _vote(F.col("valid"), 1, -1) for k in ("ip", "card", "phone")},
            "email": _vote(F.col("match").rlike(r"\.[A-Za-z]{2,}$"), 1, -1),
            "number": F.when(n > 12, -1).otherwise(0),  # the length of a card, but not its check digit or no card's length
            "ssn": _vote(F.col("match").rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), 1, -1),
            "local": _vote(F.col("match").rlike(r"^\(?[2-9][0-9]{2}\)?[ .-][2-9]"), 1, -1),
            "spelled": _vote(F.col("match").rlike(r"[A-Za-z]{2,}[\])]?$")),
        },
        F.lit(0),
    )


def _values() -> Column:
    """Up to three values of a span that the gazetteer may know."""
    low, digits = F.lower("match"), _digits()
    domain = F.regexp_extract(low, r"([a-z]+)$", 1)
    first = [F.substring(digits, 1, n) for n in (1, 2, 3, 4)]
    none = F.lit(None).cast("string")
    return _per_kind(
        {
            "email": F.array(domain, F.regexp_extract(low, "^([^@]*@)", 1), none),
            "spelled": F.array(domain, none, none),
            "ip": F.array(F.regexp_extract("match", r"^0*([0-9]+)\.", 1), F.regexp_extract("match", r"^([0-9]+\.[0-9]+)", 1), none),
            "phone": F.array(*first[:3]),
            **{k: F.array(first[0], first[1], first[3]) for k in ("card", "number")},
            "name": F.array(F.element_at(F.split(low, " "), -1), none, none),
        },
        F.array(none, none, none),
    )


def _listed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``listed``, the gazetteer's vote, by one join for each value.

    A number that no issuer has speaks against it; that one has, by itself, for nothing where the check digit fails: a quarter
    of all digit runs begin like some issuer's.
    """
    n = F.length(_digits())
    rows = rows.withColumn("values", _values())
    votes = []
    for i in range(3):
        own = known.select(F.col("kind").alias("__kind"), F.col("value").alias("__value"), F.col("vote").alias(f"__vote{i}"), F.col("least").alias(f"__least{i}"), F.col("most").alias(f"__most{i}"))
        same = (F.col("kind") == F.col("__kind")) & (F.col("values")[i] == F.col("__value"))
        rows = rows.join(F.broadcast(own), same, "left").drop("__kind", "__value")  # a table of fixed size
        votes.append(F.when(n.between(F.col(f"__least{i}"), F.col(f"__most{i}")), F.col(f"__vote{i}")).when(F.col(f"__vote{i}").isNotNull(), -1))
    issued = F.col("kind").isin([list(PATTERNS).index(k) for k in ("card", "number")]) & (n > 12)
    listed = F.coalesce(F.least(*votes), F.when(issued, -1), F.lit(0))
    listed = F.when((F.col("kind") == list(PATTERNS).index("number")) & (n > 12), F.least(listed, F.lit(0))).otherwise(listed)
    return rows.withColumn("listed", listed).drop("values", *[f"__{c}{i}" for c in ("vote", "least", "most") for i in range(3)])


def _voted(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``valid`` and the vote of each labeler: 1 for, -1 against, 0 none; drops what overlaps a valid base span."""
    rows = candidates.withColumn("valid", _valid()).withColumn("form", _form())
    anchor = F.col("valid") & (F.col("kind") < len(BASE))
    by = Window.partitionBy("key1", "key2")
    so_far = lambda *order: by.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "__before": F.max(F.when(anchor, F.col("end"))).over(so_far("start", "end", "kind")),
            "__after": F.min(F.when(anchor, F.col("start"))).over(so_far(F.desc("start"), F.desc("end"), F.desc("kind"))),
        }
    )
    clash = F.coalesce(F.col("__before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("__after") < F.col("end"), F.lit(False))
    rows = rows.filter((F.col("kind") < len(BASE)) | ~clash)
    beside = F.coalesce(F.col("start") - F.col("__before") <= NEAR, F.lit(False)) | F.coalesce(F.col("__after") - F.col("end") <= NEAR, F.lit(False))
    cue = _per_kind({k: F.col("before").rlike(c) for k, c in CUES.items()}, F.lit(False))
    context = F.when(F.col("before").rlike(AGAINST), -1).when(cue | beside, 1).otherwise(0)
    return _listed(rows.withColumn("context", context), known).drop("__before", "__after")


@dataclass(frozen=True)
class Model:
    """Weights of the span classifier, and the labelers' reliabilities P(vote | label)."""

    bias: float
    kinds: dict[int, float]
    votes: dict[tuple[str, int], float]
    reliability: dict[tuple[str, int, int], float]

    def accepts(self) -> Column:
        total = F.lit(self.bias)
        for kind, w in self.kinds.items():
            total = total + F.when(F.col("kind") == kind, w).otherwise(0.0)
        for (labeler, vote), w in self.votes.items():
            total = total + F.when(F.col(labeler) == vote, w).otherwise(0.0)
        return total > 0


def learn(patterns: list[tuple[int, int, int, int, int]], known: list[float | None] | None = None) -> Model:
    """Fit on (kind, form, listed, context, count) rows: at most 54 for each kind, whatever the corpus.

    Votes are taken as independent given the label.  ``known``: the label of a row where
    it is given, else null; such a row was chosen by its form, so it says nothing of
    how much that vote is worth.  The start trusts each labeler a little, so that label 1
    stays "personal".
    """
    known = known or [None] * len(patterns)
    rel = {(n, y, v): (0.6 if (v > 0) == y and v else 0.1 if v else 0.3) for n in LABELERS for y in (0, 1) for v in (-1, 0, 1)}
    prior = {p[0]: 0.5 for p in patterns}
    soft = [0.5] * len(patterns)
    for _ in range(EM_ROUNDS if patterns else 0):
        for i, (kind, *votes, _) in enumerate(patterns):
            yes, no = prior[kind], 1 - prior[kind]
            for name, v in zip(LABELERS, votes, strict=True):
                yes, no = yes * rel[name, 1, v], no * rel[name, 0, v]
            soft[i] = yes / (yes + no) if known[i] is None else known[i]
        for kind in prior:
            own = [(s, p[4]) for s, p in zip(soft, patterns, strict=True) if p[0] == kind]
            prior[kind] = (1 + sum(s * n for s, n in own)) / (2 + sum(n for _, n in own))
        for j, name in enumerate(LABELERS, 1):
            for y in (0, 1):
                own = [(s if y else 1 - s) * p[4] * (name != "form" or k is None) for s, p, k in zip(soft, patterns, known, strict=True)]
                for v in (-1, 0, 1):
                    agreed = sum(w for w, p in zip(own, patterns, strict=True) if p[j] == v)
                    # a few pretended votes of the starting belief keep the labels' meaning
                    start = 0.6 if (v > 0) == y and v else 0.1 if v else 0.3
                    rel[name, y, v] = (agreed + 20 * start) / (sum(own) + 20)
    bias, kinds, votes = 0.0, {k: 0.0 for k in range(len(PATTERNS))}, {(n, v): 0.0 for n in LABELERS for v in (-1, 1)}
    total = max(1, sum(p[4] for p in patterns))
    for _ in range(FIT_ROUNDS if patterns else 0):
        steps: dict = {}
        for s, (kind, *own, n), given in zip(soft, patterns, known, strict=True):
            cells = [("k", kind), *((name, v) for name, v in zip(LABELERS, own, strict=True) if v and (name != "form" or given is None))]
            z = bias + kinds[kind] + sum(votes[c] for c in cells[1:])
            g = (s - 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))) * n / total
            for c in ["bias", *cells]:
                steps[c] = steps.get(c, 0.0) + g
        for c, g in steps.items():
            if c == "bias":
                bias += 2 * g
            elif c[0] == "k":
                kinds[c[1]] += 2 * g - 2e-3 * kinds[c[1]]
            else:
                votes[c] += 2 * g - 2e-3 * votes[c]
    return Model(bias, kinds, votes, rel)


def candidates(docs: DataFrame, more: tuple[gazetteer.Row, ...] = ()) -> DataFrame:
    """Candidates of every distinct text: key1, key2, kind, start, end (code points, end exclusive), valid, votes."""
    once = _exploded(docs).groupBy("key1", "key2", "kind", "at").agg(*[F.min(c).alias(c) for c in ("gap", "match", "before")])
    upto = Window.partitionBy("key1", "key2", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(upto)
    placed = once.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("match"))
    known = gazetteer.table_of(docs.sparkSession, PATTERNS, more)
    return _voted(placed.drop("at", "gap"), known).select("key1", "key2", "kind", "start", "end", "valid", *LABELERS)


def text_spans(docs: DataFrame, more: tuple[gazetteer.Row, ...] = ()) -> DataFrame:
    """key1, key2 and ``found``: array<struct<kind, start, end>> by kind and start, of every text that has spans.

    Null and empty texts have none.  Texts go by key, so repeated rows and null ids
    need no care.  Only the counts of vote patterns come to the driver.
    """
    voted = checkpointed(candidates(docs, more))
    counts = voted.groupBy("kind", *LABELERS, "valid").agg(F.count("*").alias("n")).orderBy("kind", *LABELERS, "valid").collect()
    anchors = [1.0 if r["valid"] and r["kind"] < len(BASE) else None for r in counts]
    model = learn([(r["kind"], *(r[x] for x in LABELERS), r["n"]) for r in counts], anchors)
    spoken_for = F.greatest(*LABELERS) > 0  # where all abstain the kind's share alone would decide
    stands = F.when(F.col("kind") < len(BASE), F.col("valid")).otherwise(model.accepts() & spoken_for)
    spans = voted.filter(stands).groupBy("key1", "key2").agg(F.collect_list(F.struct("kind", "start", "end")).alias("found"))  # one text's
    return spans.withColumn("found", F.array_sort("found"))


def _shown(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in PATTERNS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, counts of the base kinds, base_sha256, spans.

    Null and empty texts have no spans; repeated rows are judged alike; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    found = checkpointed(text_spans(docs))
    rows = docs.select("doc_id", *text_key("text")).join(broadcast_if_light(found, F.size("found") + 1, BROADCAST_SPANS), ["key1", "key2"], "left")
    spans = F.coalesce("found", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"))
    rows = rows.select("doc_id", spans.alias("found")).withColumn("base", F.filter("found", lambda s: s["kind"] < len(BASE)))
    counts = [F.size(F.filter("base", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.sha2(_shown(F.col("base")).cast("binary"), 256).alias("base_sha256"), _shown(F.col("found")).alias("spans"))


def _is(kind: int):
    return lambda s: s["kind"] == kind


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets and n_chars counted anew; texts without spans, nulls among them, stay as they are."""
    found = checkpointed(text_spans(docs)).select(F.col("key1").alias("__key1"), F.col("key2").alias("__key2"), F.col("found").alias("__found"))
    key1, key2 = text_key("text")
    rows = docs.withColumns({"__pii1": key1, "__pii2": key2})
    same = (F.col("__pii1") == F.col("__key1")) & (F.col("__pii2") == F.col("__key2"))
    rows = rows.join(broadcast_if_light(found, F.size("__found") + 1, BROADCAST_SPANS), same, "left")
    in_order = F.array_sort(F.transform("__found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in PATTERNS])
    begin = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit("").alias("text"))

    def step(done: Column, s: Column) -> Column:
        kept = F.substr(F.col("text"), (done["upto"] + 1).cast("int"), (s["start"] - done["upto"]).cast("int"))
        more = F.concat(done["text"], kept, F.get(names, s["kind"]))
        # a span that begins within the one before only extends it
        return F.struct(
            F.greatest(done["upto"], s["end"]).alias("upto"),
            F.when(s["start"] >= done["upto"], more).otherwise(done["text"]).alias("text"),
        )

    def finish(done: Column) -> Column:
        return F.concat(done["text"], F.substr(F.col("text"), (done["upto"] + 1).cast("int")))

    masked = F.when(F.col("__found").isNull(), F.col("text")).otherwise(F.aggregate(in_order, begin, step, finish))
    out = rows.withColumn("text", masked)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("__found").isNull(), F.col("n_chars")).otherwise(F.length("text"))
        out = out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op10_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; see ``find_pii`` for nulls, empty texts, repeated rows and other columns."""
    return find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
