"""Personal data by weak supervision, with DataFrame functions only.

Candidates are the matches of the four strict patterns, matches that fail a strict test (a number whose check digit is wrong), and looser forms
(an address written with "at" and "dot", a telephone number without +). Five labelers vote on each (+1, 0, -1): the strict pattern, gazetteers
(top-level domains, card issuers, country codes), words in the 48 characters before it (back to the last match of that kind at most), its shape,
and repetition of one digit. The votes are counted by pattern over the whole corpus; expectation-maximisation on that bounded table estimates how
reliable each labeler is in either class. Every candidate then has a probability, and a logistic span classifier is trained on all of them from what
a span is and where it stands (FIELDS: kind, form, number of digits, separators, the characters around it, the word before it), without the votes:
their counts, too, are a table of bounded size. It runs as a column expression and decides alone: strict matches always stay, and another candidate
is added if its probability is ADD_AT or more and it overlaps no strict match.

A null text counts as empty and has no spans; each row gives one row, repeated ones too. Positions are code points, ends exclusive.
Columns other than doc_id and text are not read. In an empty table nothing is learned and nothing returned. Texts of very many candidates are
worked on in chunks of CHUNK of them, so that no list is copied for each of its elements.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.llm.common import written

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LABELERS = ("v_pattern", "v_gazetteer", "v_context", "v_shape", "v_digits")
#: What the span classifier sees, and how many values each has; the driver gets at most their product of rows.
FIELDS = {"kind": 4, "form": 3, "size": 6, "signs": 8, "before": 6, "after": 6, "word": 4}
ADD_AT, CHUNK = 0.8, 256
NOTHING = "array<struct<kind:int,begin:int,end:int,m:string,left:string,right:string>>"

# Each is equal to the plain pattern but needs no backtracking over long runs: a match begins where a run begins, or where the last match ended.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    EMAIL: rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9](?:[\x20-]?[0-9])++",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE_EMAIL = rf"(?i)(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{{1,63}}(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{{2,63}}){{1,4}}"
LOOSE_PHONE = r"(?<![0-9+.,-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.,-])"

# fixed values: word lists of the gazetteer and context labelers
TOP_LEVEL = "com|org|net|edu|gov|mil|int|info|biz|io|co|me|ai|app|dev|eu|uk|us|de|fr|es|it|nl|be|ch|at|pl|pt|se|no|dk|fi|ie|ca|mx|br|ar|cl|au|nz|jp|cn|in|ru|tr"
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|30|38)"
FOR = {
    EMAIL: "e-?mail|mail|contact|write|reach|adresse|correo|courriel|kontakt|contacto",
    IP: "ip|address|host|server|client|login|from|adresse|direcci.n|serveur",
    CARD: "card|visa|mastercard|amex|credit|debit|karte|kreditkarte|carte|tarjeta|cc",
    PHONE: "phone|tel|telephone|call|mobile|cell|fax|whatsapp|telefon|rufen|handy|t.l.phone|appelez|tel.fono|llame|m.vil",
}
AGAINST = "version|isbn|issn|order|invoice|ticket|serial|sku|doi|item|page|figure|section|total|amount|build|release|bestellung|rechnung|commande|facture|pedido|factura|seite"


def let(value: Column, of) -> Column:
    """of(value), with value computed once however often of uses it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def chunks(x: Column) -> Column:
    """An array as an array of arrays of CHUNK elements; x must be cheap to repeat."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda i: F.slice(x, i * CHUNK + 1, F.lit(CHUNK)))


def running(values: Column, start: Column, merge) -> Column:
    """start, merge(start, first), ...: one element more than values."""
    return F.aggregate(values, F.array(start), lambda s, v: F.concat(s, F.array(merge(F.element_at(s, -1), v))))


def found(text: Column, kind: int, pattern: str, guard: Column) -> Column:
    """The pattern's matches with position and what stands around: pieces between matches and matches alternate."""

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["b"])
        end = begin + F.length(x["m"])
        left, right = F.right(x["b"], F.lit(48)), F.left(x["a"], F.lit(1))
        one = F.struct(F.lit(kind).alias("kind"), begin.alias("begin"), end.alias("end"), x["m"].alias("m"), left.alias("left"), right.alias("right"))
        return F.when(x["m"].isNull(), s).otherwise(F.struct(end.alias("at"), F.concat(s["out"], F.array(one)).alias("out")))

    def placed(parts: Column) -> Column:
        start = running(F.transform(parts, lambda p: p["at"]), F.lit(0), lambda s, n: s + n)
        moved = lambda x, o: x.withField("begin", x["begin"] + o).withField("end", x["end"] + o)
        return F.flatten(F.zip_with(parts, start, lambda p, o: F.transform(F.coalesce(p["out"], F.array().cast(NOTHING)), lambda x: moved(x, o))))

    def spans(both: Column) -> Column:
        empty = F.struct(F.lit(0).alias("at"), F.array().cast(NOTHING).alias("out"))
        rows = F.zip_with(both["m"], both["p"], lambda m, b: F.struct(m.alias("m"), b.alias("b")))
        rows = F.zip_with(rows, F.slice(both["p"], 2, F.size(both["p"])), lambda x, a: F.struct(x["m"].alias("m"), x["b"].alias("b"), a.alias("a")))
        return let(rows, lambda r: let(F.transform(chunks(r), lambda c: F.aggregate(c, empty, step)), placed))

    both = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return F.when(guard, let(both, spans)).otherwise(F.array().cast(NOTHING))


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        v = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(v > 4, v * 2 - 9).otherwise(v * 2)
        return s + F.when(i % 2 == 0, twice).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _sort_of(c: Column) -> Column:
    """Of a character: 0 none or a blank, 1 letter, 2 digit, 3 one that announces a value, 4 a bracket, 5 another sign."""
    return (
        F.when((c == "") | c.isNull() | c.rlike(r"^\s"), 0).when(c.rlike(r"^[\p{L}\p{M}]"), 1).when(c.rlike(r"^\p{N}"), 2)
        .when(c.rlike("^[:=\"'#]"), 3).when(c.rlike(r"^[()\[\]{}<>]"), 4).otherwise(5)
    )


def _described(strict: bool):
    """A match with its votes and the classifier's fields; base: it passes the strict test of its kind."""
    byte = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

    def of(x: Column) -> Column:
        k, m = x["kind"], x["m"]
        digits = F.regexp_replace(m, "[^0-9]", "")
        n = F.length(digits)
        passes = (
            F.when(k == EMAIL, F.lit(True)).when(k == IP, m.rlike(rf"^{byte}(?:\.{byte}){{3}}$"))
            .when(k == PHONE, n.between(10, 15)).otherwise(F.when(n.between(14, 19), luhn(digits)).otherwise(F.lit(False)))
        )
        base = passes if strict else F.lit(False)
        vote = lambda yes, no: F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0)).cast("byte")
        never = F.lit(False)
        words, named = F.lit(False), F.lit(False)
        last = F.regexp_extract(x["left"], r"(\p{L}[\p{L}-]*)[^\p{L}]*$", 1)
        for kind, w in FOR.items():
            words = words | ((k == kind) & x["left"].rlike(rf"(?i)(?<![\p{{L}}])(?:{w})(?![\p{{L}}])"))
            named = named | ((k == kind) & last.rlike(rf"(?i)^(?:{w})$"))
        signs = F.when(m.rlike(r"\s"), 1).otherwise(0) + F.when(m.contains("-"), 2).otherwise(0) + F.when(m.rlike(r"[().]"), 4).otherwise(0)
        return F.struct(
            x["begin"].alias("begin"), x["end"].alias("end"), k.alias("kind"), base.alias("base"),
            vote(base, F.lit(strict)).alias("v_pattern"),
            vote(
                ((k == EMAIL) & m.rlike(rf"(?i)(?:\.|dot\S? ?)(?:{TOP_LEVEL})$")) | ((k == CARD) & m.rlike(ISSUERS))
                | ((k == PHONE) & m.rlike(r"^\+[1-9]|^\(?[2-9]")) | ((k == IP) & m.rlike("^[1-9]")), F.lit(True),
            ).alias("v_gazetteer"),
            vote(words, x["left"].rlike(rf"(?i)(?<![\p{{L}}])(?:{AGAINST})(?![\p{{L}}])")).alias("v_context"),
            vote(
                ((k == CARD) & n.between(15, 16)) | ((k == PHONE) & n.between(10, 13)) | (k == IP)
                | ((k == EMAIL) & (F.length(m) >= 6) & m.rlike(r"(?i)@|[(\[]at[)\]]| dot |[(\[]dot")), F.lit(True),
            ).alias("v_shape"),
            vote(never, (k != EMAIL) & digits.rlike(r"^(.)\1*$")).alias("v_digits"),
            F.when(base, 0).otherwise(F.lit(1 if strict else 2)).alias("form"), F.least(F.lit(5), (n / 4).cast("int")).alias("size"), signs.alias("signs"),
            _sort_of(F.right(x["left"], F.lit(1))).alias("before"), _sort_of(x["right"]).alias("after"),
            F.when(last == "", 0).when(named, 1).when(last.rlike(rf"(?i)^(?:{AGAINST})$"), 2).otherwise(3).alias("word"),
        )

    return of


def _every(text: Column) -> Column:
    """All candidates of a text that isn't null."""
    at, digit = F.contains(text, F.lit("@")), text.rlike("[0-9][ .-]?[0-9]")
    strict = F.concat(
        found(text, EMAIL, PATTERNS[EMAIL], at), found(text, IP, PATTERNS[IP], digit & text.rlike(r"[0-9]\.[0-9]+\.")),
        F.filter(found(text, CARD, PATTERNS[CARD], digit & text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")), lambda x: F.length(F.regexp_replace(x["m"], "[^0-9]", "")).between(13, 19)),
        found(text, PHONE, PATTERNS[PHONE], F.contains(text, F.lit("+")) & digit),
    )
    loose = F.concat(found(text, EMAIL, LOOSE_EMAIL, text.rlike(r"(?i)[(\[ ]at[)\] ].{1,64}(?:dot|\.)")), found(text, PHONE, LOOSE_PHONE, digit & text.rlike(r"[0-9][)]? ?[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}")))
    return F.concat(F.transform(strict, _described(True)), F.transform(loose, _described(False)))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and the candidates of each row's text; needs doc_id, text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _every(F.coalesce(F.col("text"), F.lit(""))).alias("spans"))


def reliabilities(votes: np.ndarray, weight: np.ndarray, rounds: int = 40, belief: float = 0.5) -> np.ndarray:
    """Probability of being personal data for each vote pattern: two latent classes, held equally likely, and each labeler's three answers in either.

    That labelers are right more often than wrong counts as much as a share `belief` of all votes; without it the classes could be any two groups."""
    p = 1 / (1 + np.exp(-votes.sum(1)))
    believed = belief * weight.sum() * np.array([[0.4, 0.4, 0.2], [0.1, 0.3, 0.6]])  # of a span that isn't and one that is: against, silent, for
    for _ in range(rounds):
        log = np.zeros((len(p), 2))
        for y, q in enumerate((1 - p, p)):
            for j in range(votes.shape[1]):
                share = np.array([(weight * q)[votes[:, j] == v].sum() for v in (-1, 0, 1)]) + believed[y]
                log[:, y] += np.log(share / share.sum())[votes[:, j] + 1]
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return p


def logistic(x: np.ndarray, p: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Ridge logistic weights for soft labels, by Newton steps; the first column is the intercept."""
    beta = np.zeros(x.shape[1])
    weight = weight / max(1.0, weight.sum() / 10_000)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(beta))
        beta += np.linalg.solve(h, x.T @ (weight * (p - q)) - ridge * beta)
    return beta


def _code(of) -> Column:
    """The number of a vote pattern and kind: of(name) is a labeler's vote or the kind."""
    code = of("kind").cast("int")
    for v in LABELERS:
        code = code * 3 + of(v) + 1
    return code


def train(spans: DataFrame) -> list[tuple[str, int, float]]:
    """Terms (field, value, weight) of the span classifier. The driver gets the counts of vote patterns (at most 4 * 3^5 rows), then for each
    combination of the classifier's fields (at most their product) its spans and the sum of their probabilities."""
    each = spans.select(F.explode("spans").alias("x")).select("x.*")
    patterns = sorted(each.groupBy("kind", *LABELERS).agg(F.count("*").alias("n")).collect())
    if not patterns:
        return [("", 0, 0.0)]
    votes, kind = np.array([[r[v] for v in LABELERS] for r in patterns]), np.array([r["kind"] for r in patterns])
    p = reliabilities(votes, np.array([r["n"] for r in patterns], float))
    code = kind.copy()
    for j in range(len(LABELERS)):
        code = code * 3 + votes[:, j] + 1
    known = np.zeros(len(KINDS) * 3 ** len(LABELERS))
    known[code] = p
    likely = F.element_at(F.array(*map(F.lit, known.tolist())), _code(F.col) + 1)
    rows = sorted(each.groupBy(*FIELDS).agg(F.count("*").alias("n"), F.sum(likely).alias("p")).collect())
    weight = np.array([r["n"] for r in rows], float)
    terms = [("", 0), *((f, v) for f in FIELDS for v in sorted({r[f] for r in rows}))]
    x = np.array([[1.0 if not f else float(r[f] == v) for f, v in terms] for r in rows])
    return [(f, int(v), float(b)) for (f, v), b in zip(terms, logistic(x, np.array([r["p"] for r in rows]) / weight, weight))]


def _apart(spans: Column) -> Column:
    """Of spans in the order of their beginnings: those of base, and those that overlap none of base. A span is compared with those of its own chunk,
    with the last end in the chunks before it and with the first beginning in the chunks after it."""
    far = F.lit(2**31 - 1)

    def within(cs: Column) -> Column:
        base = F.transform(cs, lambda c: F.filter(c, lambda b: b["base"]))
        last = running(F.transform(base, lambda c: F.array_max(F.transform(c, lambda b: b["end"]))), F.lit(-1), lambda s, v: F.greatest(s, v))
        first = running(F.reverse(F.transform(base, lambda c: F.array_min(F.transform(c, lambda b: b["begin"])))), far, lambda s, v: F.least(s, v))
        beside = F.zip_with(F.slice(last, 1, F.size(cs)), F.slice(F.reverse(first), 2, F.size(cs)), lambda a, z: F.struct(a.alias("a"), z.alias("z")))

        def kept(c: Column, e: Column) -> Column:
            clear = lambda x: (x["begin"] >= e["a"]) & (x["end"] <= e["z"]) & ~F.exists(c, lambda b: b["base"] & (b["begin"] < x["end"]) & (x["begin"] < b["end"]))
            return F.filter(c, lambda x: x["base"] | clear(x))

        return F.flatten(F.zip_with(cs, beside, kept))

    return let(spans, lambda s: let(chunks(s), within))


def decided(spans: DataFrame, terms: list[tuple[str, int, float]]) -> DataFrame:
    """spans: only those that stay, by begin, then kind, then end."""

    def added(x: Column) -> Column:
        z = F.lit(0.0)
        for f, v, b in terms:
            z = z + (F.lit(b) if not f else F.when(x[f] == v, F.lit(b)).otherwise(F.lit(0.0)))
        return ~x["base"] & (z >= float(np.log(ADD_AT / (1 - ADD_AT))))

    marked = spans.withColumn("spans", F.filter("spans", lambda x: x["base"] | added(x)))
    kept = F.when(F.exists("spans", lambda x: ~x["base"]), _apart(F.array_sort("spans"))).otherwise(F.col("spans"))
    brief = lambda x: F.struct(x["begin"].alias("begin"), x["kind"].alias("kind"), x["end"].alias("end"), x["base"].alias("base"))
    return marked.withColumn("spans", F.array_sort(F.transform(kept, brief)))


def _listed(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["begin"].cast("string"), x["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (strict matches), base_sha256, spans for each row."""
    spans = written(candidates(docs))
    kept = decided(spans, train(spans))
    base = F.filter("spans", lambda x: x["base"])

    def strict(k: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long")

    counts = [strict(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return kept.select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by <KIND> in its text; n_chars, where there is one, follows. All rows and columns stay; null texts stay null.

    Overlapping spans are replaced together, by the kind of the first."""
    # the row rides as one value, so that no name in it can clash
    marked = written(docs.select(F.struct(*docs.columns).alias("row"), _every(F.coalesce(F.col("text"), F.lit(""))).alias("spans")))
    kept = decided(marked, train(marked))
    text = F.col("row")["text"]
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        name = F.element_at(F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS]), x["kind"] + 1)
        gap = F.substring(x["text"], s["at"] + 1, x["begin"] - s["at"])
        fresh = F.struct(x["end"].alias("at"), F.concat(s["out"], gap, name).alias("out"))
        return F.when(x["begin"] < s["at"], F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))).otherwise(fresh)

    # the text goes along with each span, as a lambda sees only its own variables cheaply
    spans = F.transform("spans", lambda x: F.struct(x["begin"].alias("begin"), x["kind"].alias("kind"), x["end"].alias("end"), text.alias("text")))
    done = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    fresh = F.when(text.isNull() | (F.size("spans") == 0), text).otherwise(done)
    row = F.col("row").withField("text", fresh)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(text.isNull(), F.col("row")["n_chars"]).otherwise(F.length(fresh)).cast(docs.schema["n_chars"].dataType))
    return kept.select(row.alias("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])
