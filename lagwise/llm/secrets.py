"""Secret scans: candidate strings, and a random forest that removes false positives.

Candidates are runs of 16 or more letters, digits and + / = _ - . with at least two digits, keys of 16 or more of these characters with a known
beginning that doesn't follow a letter or digit (up to the run's end, or to a = or / before the next known beginning), and values of 8 or more
characters that are assigned to a name such as token or password (the whole of a name: author is none), however long they are: a value ends at a blank,
quote, comma, semicolon or angle bracket. The forest judges length, character transitions, coverage by dictionary words, the path and the neighbouring words. It is trained from
labelled findings: a table (candidate, before, after, path, label), by default one that is generated by rule (keys of common forms, most with names that
announce them; hashes, identifiers, placeholders, names and prose that don't, and plain words, bylines, links and code after names that would announce a key).

The dictionary is the corpus's own: the DICTIONARY runs of 4 to 24 letters (longer ones are cut there) that stand in the most documents, counted over all of them.
Labelled findings are described with the same words.

Null and empty texts have no findings. Findings are reported for every row, repeated ones too, with code point positions; an empty table gives none.
Columns other than doc_id, text and the path column are not read; a null path is an empty one. Findings with a null label teach nothing, and where
labels are all alike, or none, every candidate is reported with score 1.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.llm.common import slices, written

CONTEXT, FINDINGS, TREES, DEPTH, LEAST = 48, 6000, 40, 8, 16
_RUN = re.compile(r"[A-Za-z0-9+/=_.\-]{16,}")
_ASSIGNED = re.compile(r"""(?i)(?:secret|token|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key)s?(?:[_-]?(?:key|value|token|secret|code|id|env|[0-9]{1,3})s?)*(?:[_-]\w{1,24})?(?!\w)["']?\s{0,2}(?:[:=]|=>|:=)\s{0,2}["']?([^\s"',;<>]{8,}+)""")
# fixed values: beginnings of well-known kinds of keys, and words that stand near true and false findings
KNOWN = re.compile(r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abpr]-|sk_live_|rk_live_|sk-|AIza|ya29\.|eyJ|SG\.|npm_|hf_)")
_KEY = re.compile(rf"(?<![A-Za-z0-9]){KNOWN.pattern[1:]}(?:[A-Za-z0-9+_.\-]|[=/](?!{KNOWN.pattern[1:]}))*+")
FOR = ("token", "secret", "password", "passwd", "key", "auth", "credential", "bearer", "api", "private", "login", "access")
AGAINST = ("commit", "sha", "md5", "hash", "checksum", "uuid", "id", "example", "sample", "test", "version", "digest", "revision", "build", "hex", "color", "integrity")
#: Words of the corpus that make its dictionary; words that a task counts before it hands its counts on.
DICTIONARY, FLUSH = 20_000, 200_000
_LETTERS = re.compile(r"[a-z]{4,24}")
TEST_PATH = re.compile(r"(?i)test|spec|example|sample|docs?/|mock|fixture|readme")
NAMES = ["length", "digits", "upper", "lower", "signs", "transitions", "same", "entropy", "hex", "longest_letters", "dictionary", "known", "assigned", "for_before", "against_before", "near_words", "placeholder", "test_path", "depth", "dots"]


def candidates(text: str) -> list[tuple[int, int, bool]]:
    """begin, end, assigned: assigned values, known keys wherever they begin, and what is left of runs beside both. Only a key inside a value overlaps it."""
    named = list(_ASSIGNED.finditer(text))
    out = {m.span(1): True for m in named}
    first = 0
    for run in _RUN.finditer(text):
        while first < len(named) and named[first].end() <= run.start():
            first += 1
        # begin, end, free: the parts of the run that lie beside assignments, and those that lie in their values
        parts, at = [], run.start()
        for k in range(first, len(named)):
            m = named[k]
            if m.start() >= run.end():
                break
            parts += [(at, m.start(), True), (max(run.start(), m.start(1)), min(run.end(), m.end()), False)]
            at = m.end()
        for begin, end, free in [*parts, (at, run.end(), True)]:
            for key in _KEY.finditer(text, begin, max(begin, end)):
                if len(key[0]) >= LEAST:
                    if free and _is_run(text[begin : key.start()]):
                        out[begin, key.start()] = False
                    out.setdefault(key.span(), False)
                    begin = key.end()
            if free and _is_run(text[begin:end]):
                out[begin, end] = False
    return sorted((b, e, assigned) for (b, e), assigned in out.items())


def _is_run(s: str) -> bool:
    return len(s) >= LEAST and sum(map(str.isdigit, s)) >= 2 and bool(re.search("[A-Za-z]", s))


def covered(s: str, dictionary: frozenset[str]) -> int:
    """Letters of s that lie in dictionary words: from left to right, the longest word that begins at a letter, of at most 24 letters."""
    n = 0
    for run in re.findall("[a-z]{4,}", s.lower()):
        at = 0
        while at + 4 <= len(run):
            end = next((e for e in range(min(len(run), at + 24), at + 3, -1) if run[at:e] in dictionary), 0)
            n += max(0, end - at)
            at = end or at + 1
    return n


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> frozenset[str]:
    """The words of the most documents; ties by spelling. The driver gets size words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return got

        for p in slices(batches):
            for text in p["text"]:
                counts.update(set(_LETTERS.findall((text or "").lower())))
            if len(counts) > FLUSH:
                yield out()
        yield out()

    rows = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return frozenset(r["word"] for r in rows.collect())


def features(s: str, before: str, after: str, path: str, assigned: bool, words_known: frozenset[str] = frozenset()) -> list[float]:
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in s]
    n = max(1, len(s))
    share = np.unique(list(s) or [" "], return_counts=True)[1] / n
    words = re.findall(r"[a-z0-9]+", before.lower())[-6:]
    near = words[-3:]
    return [
        float(n), kind.count("d") / n, kind.count("u") / n, kind.count("l") / n, kind.count("s") / n, sum(a != b for a, b in zip(kind, kind[1:])) / n, sum(a == b for a, b in zip(s, s[1:])) / n, float(-(share * np.log2(share)).sum()),
        float(bool(re.fullmatch(r"(?:[0-9a-f]+|[0-9A-F]+)", s))), float(max(map(len, re.findall(r"[A-Za-z]+", s)), default=0)), covered(s, words_known) / n, float(bool(KNOWN.match(s))), float(assigned or bool(re.search(r"[:=]\s{0,2}[\"']?$", before))),
        float(any(f in w for w in near for f in FOR)), float(any(w == f for w in near for f in AGAINST)), float(len(re.findall(r"[A-Za-z]{2,}", after[:24]))), float(bool(re.search(r"(?i)your|xxxx|example|changeme|placeholder|dummy|1234567|abcdef|<|\$\{", s))),
        float(bool(TEST_PATH.search(path))), float(path.count("/")), float(s.count(".")),
    ]


def labelled_findings(n: int = FINDINGS, seed: int = 3) -> list[tuple[str, str, str, str, int]]:
    """Findings by rule, half of them secrets: candidate, before, after, path, label."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    chars = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    hexa, base, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: "".join(pick(("th", "er", "on", "an", "re", "in", "ed", "es", "ou", "ti", "en", "at", "ing", "ion")) for _ in range(int(rng.integers(1, 5))))
    prose = lambda k: " ".join(word() for _ in range(k))
    out = []
    for i in range(n):
        path = pick(("", "src/app/config.py", "deploy/prod.env", "lib/a/b.js", "tests/data.txt", "docs/readme.md", "https://a.example/x/y", f"src{int(rng.integers(20))}"))
        tail = pick(('" ', "\n", "' ", " ")) + prose(int(rng.integers(0, 4)))
        if i % 2:
            s = pick((lambda: chars(hexa, pick((32, 40, 64))), lambda: chars(base, pick((24, 32, 40, 44))), lambda: "AKIA" + chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: "ghp_" + chars(alnum, 36), lambda: chars(alnum, int(rng.integers(16, 48))), lambda: chars(alnum + "!#%&", int(rng.integers(10, 20)))))()
            # one in five is announced by nothing that a name feature knows
            name = pick(FOR) + pick(("", "", "_key", "_value", "-token")) if rng.random() < 0.8 else pick(("config", "value", "x-signature", "conn", word()))
            before = prose(int(rng.integers(0, 5))) + " " + name + pick((" = ", "=", ": ", " = \"", '": "', " ", "='"))
            out.append((s, before[-CONTEXT:], tail, path, 1))
        else:
            kind = int(rng.integers(11))
            h, plain = chars(hexa, 32), pick(("administrator", "Jonathan", "required", "forgotten", "Christopher", "unauthorized", "authentication", "documentation", "Massachusetts", "undefined", "null_value", word() + word() + word(), word().title() + word() + word()))
            named = pick(FOR) + pick(("", "s", "_name", "_type", "_policy")) + pick((": ", " = ", "=", ': "', " - "))
            s, name = (
                (chars(hexa, pick((7, 32, 40, 64)) + 9), pick(("commit ", "sha256: ", "md5 ", "checksum=", "revision ", "integrity "))), (f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", pick(("uuid ", "id=", "id: "))),
                (pick(("your_api_key_here_123", "xxxxxxxxxxxxxxxx0000", "EXAMPLE_KEY_1234567", "changeme12345678")), pick(("token = ", "api_key=", "secret: "))), ("_".join(word() for _ in range(4)) + chars("0123456789", 3), prose(3) + " "),
                ("/".join(word() + chars("0123456789", 1) for _ in range(4)) + ".html", prose(2) + " "), (chars("0123456789", int(rng.integers(14, 20))) + pick(("", "-a1")), prose(2) + " "), (word() + word() + word() + word() + chars("0123456789", 2), prose(4) + " "),
                (plain, pick((named, "author: ", "authors: ", "by: "))), ("https://" + ".".join(word() for _ in range(3)) + "/" + "/".join(word() for _ in range(int(rng.integers(1, 4)))), pick((named, "authors: ", "see: "))),
                (pick((f"get_{word()}_{word()}()", f"os.environ[{word().upper()}]", f"self.{word()}.{word()}", f"{word()}{word().title()}{word().title()}", f"config.{word()}_{word()}", f"{word()}-{word()}-{word()}")), named),
                (prose(1) + word() + pick((".", ")", ":", "!", "?")) + word(), named),
            )[kind]
            out.append((s, (prose(int(rng.integers(0, 4))) + " " + name)[-CONTEXT:], tail, path, 0))
    return out


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel | None:
    """findings: f array<double>, label int; None where there are not both labels."""
    if findings.select("label").distinct().count() < 2:
        return None
    rows = findings.select(array_to_vector("f").alias("features"), F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, featuresCol="features", labelCol="label").fit(rows)


def described(findings: DataFrame, words_known: frozenset[str] = frozenset()) -> DataFrame:
    """f and label of findings (candidate, before, after, path, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in slices(batches):
            f = [features(c or "", b or "", a or "", q or "", False, words_known) for c, b, a, q in zip(p["candidate"], p["before"], p["after"], p["path"])]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), pa.array(p["label"], pa.int32())], ["f", "label"])

    return findings.select("candidate", "before", "after", "path", F.col("label").cast("int").alias("label")).where("label is not null").mapInArrow(run, "f array<double>, label int")


def found(docs: DataFrame, path: str = "source", words_known: frozenset[str] = frozenset()) -> DataFrame:
    """doc_id, begin, end, secret, f: all candidates of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in slices(batches):
            out = []
            for doc, text, where in zip(p["doc_id"], p["text"], p["path"]):
                for b, e, assigned in candidates(text or ""):
                    out.append((doc, b, e, text[b:e], features(text[b:e], text[max(0, b - CONTEXT) : b], text[e : e + CONTEXT], where or "", assigned, words_known)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, types)], ["doc_id", "begin", "end", "secret", "f"])

    where = F.col(path).cast("string") if path in docs.columns else F.lit("")
    return docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", where.alias("path")).mapInArrow(run, "doc_id long, begin long, end long, secret string, f array<double>")


def generated(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_findings(), "candidate string, before string, after string, path string, label int")


def scan(docs: DataFrame, findings: DataFrame | None = None, path: str = "source") -> DataFrame:
    """doc_id, begin, end, secret_sha256, score, is_secret for each candidate of each row."""
    known = dictionary(docs)
    model = train(written(described(generated(docs.sparkSession) if findings is None else findings, known)))
    rows = found(docs, path, known)
    if model is None:
        judged = rows.withColumn("score", F.lit(1.0))
    else:
        judged = model.transform(rows.withColumn("features", array_to_vector("f"))).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return judged.select("doc_id", "begin", "end", F.sha2(F.col("secret").cast("binary"), 256).alias("secret_sha256"), F.round("score", 6).alias("score"), (F.col("score") >= 0.5).alias("is_secret"))
