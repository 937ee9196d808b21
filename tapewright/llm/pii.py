"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Strict patterns give the base spans, which always stay. Looser patterns give
further candidates. On every candidate the labelers vote yes, no or nothing: a
check of its digits or ending, gazetteers (domain endings, dialling and issuer
prefixes), cue words before the span, words that speak against it, and its
shape. Over the whole table the combinations of votes are counted;
expectation-maximisation on those counts estimates each labeler's reliability
and each combination's probability. With these as soft labels a logistic
classifier is fitted on what the labelers don't share out in words: the span's
own shape and length, the word before it and what follows, besides the votes.
Candidates beyond the base that it accepts are added. DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.storage import materialize

KINDS = ("email", "ip", "card", "phone")
OPEN, CLOSE = "\x01", "\x02"  # marks around matches; in a text itself they become \x03, which no pattern holds

#: Strict patterns. Possessive, as what follows a run can't be part of it, so no match is tried twice.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser patterns for further candidates: written-out addresses, long addresses, cards with other separators, numbers without a plus.
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{1,63}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9./_])[0-9]{4}(?:[./_][0-9]{4}){2}[./_][0-9]{1,7}(?![0-9./_])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|00?[0-9]{1,4}[ /-]|[0-9]{3}[ .-](?=[0-9]{3}[ .-]))(?:[0-9]{2,5}[ .-]?){1,4}[0-9]{2,5}(?![0-9])",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@", "phone": "+"}

# Fixed values of the gazetteer and context labelers.
ENDINGS = "com org net edu gov int io info de fr es uk it nl eu ch at us ca au jp br in mx pl se no fi dk pt be cz".split()
DIALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 358 380 420".split()
CUES = {
    "email": "e-?mail|mail|contact|write|kontakt|correo|courriel|schreib|address",
    "ip": "ip|ipv6|host|server|address|addr|login|serveur|client",
    "card": "card|visa|mastercard|amex|karte|carte|tarjeta|pay(?:ment)?|credit",
    "phone": "tel|tel[eé]fono|phone|call|fax|mobile|cell|anruf(?:en)?|appel(?:ez)?|llam[ae]|whatsapp|hotline",
}
AGAINST = r"(?:version|release|isbn|issn|order|invoice|ref|article|page|section|fig|serial|part|bestellung|commande|pedido)[a-z]*[.: #]*(?:no\.?|nr\.?|number)?[ :#]*$|[vV][.]? ?$|[$€£] ?$"
VOTES = ("valid", "listed", "cue", "against", "shape")
#: Buckets of the hashed shape, of the word before a span, and classes of what follows it.
SHAPES, WORDS, AFTER = 32, 64, 4


#: Items that a scan takes before it puts its results aside.
CHUNK = 256


def scanned(items: Column, begin: Column, step, of: str) -> Column:
    """``step(state, item) -> (state, result)`` along an array: the results, of type ``of``.

    Results are gathered chunk by chunk, as an array that grows by one element is copied each time.
    """
    none = F.array().cast(f"array<{of}>")

    def along(part: Column, state: Column) -> Column:
        def put(acc: Column, item: Column) -> Column:
            now, result = step(acc["state"], item)
            return F.struct(now.alias("state"), F.concat(acc["found"], F.array(result)).alias("found"))

        return F.aggregate(part, F.struct(state.alias("state"), none.alias("found")), put)

    def chunk(acc: Column, number: Column) -> Column:
        part = F.slice(acc["items"], number * CHUNK + 1, F.lit(CHUNK))
        aside = F.concat(acc["aside"], F.array(acc["last"]["found"]))
        return F.struct(acc["items"].alias("items"), along(part, acc["last"]["state"]).alias("last"), aside.alias("aside"))

    # The array is handed along, so that it is made once.
    first = F.struct(items.alias("items"), F.struct(begin.alias("state"), none.alias("found")).alias("last"), F.array().cast(f"array<array<{of}>>").alias("aside"))
    numbers = F.sequence(F.lit(0), F.floor(F.size(items) / CHUNK).cast("int"))
    return F.aggregate(numbers, first, chunk, lambda acc: F.flatten(F.concat(acc["aside"], F.array(acc["last"]["found"]))))


SPAN = "struct<start:bigint,stop:bigint,value:string,before:string,after:string>"


def marked_spans(text: Column, pattern: str, valid=None) -> Column:
    """``array<struct<start, stop, value, before, after>>`` of a pattern's leftmost matches; ``valid``: a test of their text.

    Positions are code points, the end exclusive. The text is marked around the
    matches and split at the marks; the pieces' lengths give the positions.
    """
    clean = F.translate(text, OPEN + CLOSE, "\x03\x03")
    pieces = F.split(F.regexp_replace(clean, pattern, f"{OPEN}$0{CLOSE}"), OPEN, -1)

    def step(state: Column, piece: Column) -> tuple[Column, Column]:
        # The first piece lies before all matches; it has no mark at its end.
        value = F.when(piece.contains(CLOSE), F.substring_index(piece, CLOSE, 1)).otherwise("")
        rest = F.when(piece.contains(CLOSE), F.substring(piece, F.length(value) + 2, F.length(piece))).otherwise(piece)
        start, stop = state["at"], state["at"] + F.length(value)
        span = F.struct(start.alias("start"), stop.alias("stop"), value.alias("value"), state["before"].alias("before"), F.left(rest, F.lit(1)).alias("after"))
        return F.struct((stop + F.length(rest)).alias("at"), F.right(rest, F.lit(30)).alias("before")), span

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("before"))
    found = F.filter(scanned(pieces, begin, step, SPAN), lambda s: s["value"] != "")
    found = F.filter(found, lambda s: valid(s["value"])) if valid else found
    return F.when(clean.rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


VALID = {
    "email": None,
    "ip": lambda v: v.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"),
    "card": lambda v: F.length(_digits(v)).between(13, 19) & F.call_function("luhn_check", _digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def _votes(kind: str, value: Column, before: Column) -> list[Column]:
    """The five labelers' votes, 1, -1 or 0, in the order of VOTES."""
    low, digits = F.lower(value), _digits(value)
    ending = r"(?:\.|[\[(]dot[\])]) ?"
    valid = {
        "email": low.rlike(rf"^[a-z0-9].*{ending}[a-z]{{2,}}$"),
        "ip": value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$|^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$"),
        # A digit repeated passes the check sum without a meaning.
        "card": F.length(digits).between(13, 19) & F.call_function("luhn_check", digits) & ~digits.rlike(r"^([0-9])\1+$"),
        "phone": F.length(digits).between(9, 15),
    }[kind]
    listed = {
        "email": low.rlike(ending + "(?:" + "|".join(ENDINGS) + ")$"),
        "ip": ~value.rlike(r"^(?:0|127|255)\.|^[0-9]\.[0-9]\.[0-9]\.[0-9]$|^[0-9]{1,2}(?::[0-9]{1,2})+$"),
        "card": digits.rlike(r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6)"),
        "phone": value.rlike(r"^(?:(?:\+|00 ?)(?:" + "|".join(DIALLING) + r")|\(|0[1-9]|[2-9][0-9]{2}[ .-])"),
    }[kind]
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    never = F.lit(False)
    odd_shape = digits.rlike(r"^(?:([0-9])\1+|0?123456789[0-9]*)$")
    return [
        vote(valid, ~valid),
        vote(listed, ~listed),
        vote(F.lower(before).rlike(rf"(?:^|[^\p{{L}}])(?:{CUES[kind]})[^\p{{L}}]"), never),
        vote(never, F.lower(before).rlike(AGAINST)),
        vote((F.length(value) >= 8) & ~odd_shape, odd_shape | (F.length(value) < 6)),
    ]


def _bucket(text: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(n)).cast("int")


def _candidates(text: Column, kind: str, strict: bool) -> Column:
    spans = marked_spans(text, (STRICT if strict else LOOSE)[kind], VALID[kind] if strict else None)

    def described(s: Column) -> Column:
        votes = _votes(kind, s["value"], s["before"])
        size = F.least((F.length(s["value"]) / 6).cast("int"), F.lit(4))
        shape = F.regexp_replace(F.regexp_replace(s["value"], "[A-Za-z]+", "a"), "[0-9]+", "9")
        after = F.when(s["after"] == "", 0).when(s["after"].rlike(r"[\s.,;!?)]"), 1).when(s["after"].rlike(r"[\p{L}0-9]"), 2).otherwise(3)
        word = F.lower(F.regexp_extract(s["before"], r"(\p{L}+)[^\p{L}]*$", 1))
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"),
            *[v.cast("int").alias(n) for n, v in zip(VOTES, votes, strict=True)], size.alias("size"), _bucket(shape, SHAPES).alias("shape_of"), _bucket(word, WORDS).alias("word"), after.alias("next"),
        )

    found = F.transform(spans, described)
    if strict:
        return F.when(text.contains(NEEDS[kind]), found).otherwise(_none()) if kind in NEEDS else found
    return F.when(F.lower(text).rlike(r"[\[(]at[\])]"), found).otherwise(_none()) if kind == "email" else found


FEATURES = (*VOTES, "size", "shape_of", "word", "next")


def _none() -> Column:
    fields = "kind:int,start:bigint,stop:bigint," + ",".join(f"{v}:int" for v in FEATURES)
    return F.array().cast(f"array<struct<{fields}>>")


def _free(spans: Column, taken: Column) -> Column:
    """The spans that overlap none of those taken, by two passes over both in order of their starts."""
    none, far = F.lit(-1).cast("bigint"), F.lit(1 << 62).cast("bigint")
    item = lambda s, own: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), own.alias("span"))
    ordered = F.array_sort(F.concat(F.transform(taken, lambda s: item(s, F.lit(None).cast(_SPAN_TYPE))), F.transform(spans, lambda s: item(s, s))))
    both = f"struct<start:bigint,stop:bigint,span:{_SPAN_TYPE},clear:boolean>"

    def forth(reach: Column, s: Column) -> tuple[Column, Column]:
        """Spans that begin at or after the farthest end of what is taken before them."""
        now = F.when(s["span"].isNull(), F.greatest(reach, s["stop"])).otherwise(reach)
        return now, F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["span"].alias("span"), (s["start"] >= reach).alias("clear"))

    def back(following: Column, s: Column) -> tuple[Column, Column]:
        """Spans that end at or before the first start of what is taken after them."""
        now = F.when(s["span"].isNull(), F.least(following, s["start"])).otherwise(following)
        return now, F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["span"].alias("span"), (s["clear"] & (s["stop"] <= following)).alias("clear"))

    passed = scanned(F.reverse(scanned(ordered, none, forth, both)), far, back, both)
    kept = F.filter(F.reverse(passed), lambda s: s["span"].isNotNull() & s["clear"])
    return F.transform(kept, lambda s: s["span"])


_SPAN_TYPE = "struct<kind:int,start:bigint,stop:bigint," + ",".join(f"{v}:int" for v in FEATURES) + ">"


def candidate_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, base, more``: arrays of described candidates; ``more`` overlaps no base span."""
    text = F.coalesce("text", F.lit(""))
    base = F.concat(*[_candidates(text, kind, True) for kind in KINDS])
    more = F.concat(*[_candidates(text, kind, False) for kind in LOOSE])
    free = F.when((F.size("more") > 0) & (F.size("base") > 0), _free(F.col("more"), F.col("base"))).otherwise(F.col("more"))
    return docs.select("doc_id", base.alias("base"), more.alias("more")).select("doc_id", "base", free.alias("more"))


#: Where each feature's indicators start in the classifier's vector, and its least value.
WIDTHS = {"kind": (len(KINDS), 0)} | {v: (3, -1) for v in VOTES} | {"size": (5, 0), "shape_of": (SHAPES, 0), "word": (WORDS, 0), "next": (AFTER, 0)}


@dataclass
class SpanClassifier:
    """Logistic weights of a candidate's indicators, feature by feature."""

    bias: float
    weights: dict[str, list[float]]

    def score(self, c: Column) -> Column:
        """The log odds that a candidate is personal data."""
        total = F.lit(self.bias)
        for name, (_, least) in WIDTHS.items():
            total = total + F.element_at(F.array(*[F.lit(w) for w in self.weights[name]]), c[name] - least + 1)
        return total


def estimated_labels(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> list[float]:
    """Probability of each (kind, votes, count) pattern, by EM with labelers independent given the truth.

    Each kind has its own share of true spans, each labeler its own chances of
    each vote given the truth, smoothed by a prior belief, as heavy as half the
    data, that labelers are more often right than wrong, and that a true span
    rarely follows a word that speaks against it.
    """
    # What a span itself shows is weaker evidence than the words around it.
    shown = {True: {1: 0.6, 0: 0.3, -1: 0.1}, False: {1: 0.3, 0: 0.3, -1: 0.4}}
    around = {"cue": {True: {1: 0.5, 0: 0.5, -1: 0.0}, False: {1: 0.05, 0: 0.95, -1: 0.0}}, "against": {True: {1: 0.0, 0: 0.99, -1: 0.01}, False: {1: 0.0, 0: 0.6, -1: 0.4}}}
    prior = [around.get(name, shown) for name in VOTES]
    belief = 10 + sum(n for _, _, n in patterns) / 2
    share = dict.fromkeys({k for k, _, _ in patterns}, 0.5)
    chance = {(i, truth, v): p for i in range(len(VOTES)) for truth, votes in prior[i].items() for v, p in votes.items()}
    labels = [0.5] * len(patterns)
    for _ in range(rounds):
        for at, (kind, votes, _) in enumerate(patterns):
            yes, no = math.log(share[kind]), math.log(1 - share[kind])
            for i, v in enumerate(votes):
                yes, no = yes + math.log(chance[i, True, v]), no + math.log(chance[i, False, v])
            labels[at] = 1 / (1 + math.exp(min(50.0, no - yes)))
        for kind in share:
            own = [(p, n) for p, (k, _, n) in zip(labels, patterns, strict=True) if k == kind]
            share[kind] = (sum(p * n for p, n in own) + 1) / (sum(n for _, n in own) + 2)
        for i in range(len(VOTES)):
            for truth in (True, False):
                weight = {v: belief * prior[i][truth][v] for v in (-1, 0, 1)}
                for p, (_, votes, n) in zip(labels, patterns, strict=True):
                    weight[votes[i]] += n * (p if truth else 1 - p)
                for v, w in weight.items():
                    chance[i, truth, v] = w / sum(weight.values())
    return labels


def fitted_classifier(each: DataFrame, labels: DataFrame) -> SpanClassifier:
    """Fit to all candidates, one a row, by EM's probability ``p`` of their kind and votes; equal ones are counted first.

    Counts are flattened, so that a very common candidate doesn't drown the others.
    """
    counted = each.groupBy("kind", *FEATURES).agg(F.sqrt(F.count("*")).alias("n")).join(F.broadcast(labels), ["kind", *VOTES])  # a row a kind and combination of votes: 972 at most
    lit = [F.array(*[(F.col(name) == v + least).cast("double") for v in range(width)]) for name, (width, least) in WIDTHS.items()]
    both = counted.select(array_to_vector(F.concat(*lit)).alias("features"), F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("p")).alias("weight")), F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("p"))).alias("weight")))).alias("l"))
    model = LogisticRegression(regParam=1e-3, maxIter=30, standardization=False, weightCol="weight").fit(both.select("features", "l.label", "l.weight"))
    values, weights = model.coefficients.toArray().tolist(), {}
    for name, (width, _) in WIDTHS.items():
        weights[name], values = values[:width], values[width:]
    return SpanClassifier(float(model.intercept), weights)


def personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, base, added`` of every row of ``doc_id, text``: arrays of candidates.

    Null and empty texts have none; rows that repeat an id are read each on
    its own. Only counts of votes and the classifier's weights, both of fixed
    size, reach the driver.
    """
    spark = docs.sparkSession
    found = materialize(candidate_spans(docs.select("doc_id", "text")))
    each = found.select(F.explode(F.concat("base", "more")).alias("c")).select("c.*")
    counted = each.groupBy("kind", *VOTES).count().orderBy("kind", *VOTES).collect()
    if not counted:
        return found.select("doc_id", "base", F.col("more").alias("added"))
    patterns = [(r["kind"], tuple(r[v] for v in VOTES), r["count"]) for r in counted]
    rows = [(kind, *votes, p) for (kind, votes, _), p in zip(patterns, estimated_labels(patterns), strict=True)]
    labels = spark.createDataFrame(rows, "kind int, " + ", ".join(f"{v} int" for v in VOTES) + ", p double")
    model = fitted_classifier(each, labels)
    limit = math.log(threshold / (1 - threshold))
    return found.select("doc_id", "base", F.filter("more", lambda c: model.score(c) >= limit).alias("added"))


def printed_spans(spans: Column) -> Column:
    """``kind:start:end`` by kind, then start, joined by commas."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))))
    name = lambda k: F.element_at(F.array(*[F.lit(n) for n in KINDS]), k + 1)
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op5_personal_data(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans; ``n_added`` counts what the classifier added, ``n_spans`` all."""
    found = personal_data(docs)
    counts = [
        F.size(F.filter("base", lambda s: s["kind"] == 0)).cast("long").alias("n_email"),
        F.size(F.filter("base", lambda s: s["kind"] == 1)).cast("long").alias("n_ip"),
        F.size(F.filter("base", lambda s: s["kind"] == 2)).cast("long").alias("n_card"),
        F.size(F.filter("base", lambda s: s["kind"] == 3)).cast("long").alias("n_phone"),
    ]
    return found.select(
        "doc_id", *counts, F.sha2(printed_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        printed_spans(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )
