"""Secrets in text: patterns propose candidates, a random forest removes the false ones.

Candidates are key blocks, strings with the prefix of a known service, long strings that mix
letters and digits, and values assigned to a name. The forest judges each by its length,
its character transitions (against the letter pairs of all documents), how much of it common
words cover, whether it looks like a path or address, and the words beside it. It is trained
on labelled findings: strings of known kinds in the surroundings they have in real files.
"""

from __future__ import annotations

import math
import random
import re
import string
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import fresh

MIN_LENGTH, MIN_VALUE, CONTEXT = 16, 6, 48
CUT = 0.5
MASK = "[SECRET]"

# Prefixes of service keys, names that announce secrets or other strings, common words.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza", "eyJ", "npm_", "SG.")
SECRET_NAMES = re.compile(r"(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth\w*|bearer|credentials?|client[_-]?secret)", re.I)
OTHER_NAMES = re.compile(r"(commit|sha\d*|md5|hash|checksum|digest|revision|uuid|guid|etag|version|build|integrity|base64|fingerprint|trace)", re.I)
PLACEHOLDER = re.compile(r"(example|sample|your|placeholder|change.?me|dummy|todo|xxxx|\*{4}|\.{3}|<[a-z_ ]+>|\$\{|%[a-z]+%|test|1234567|abcdef)", re.I)
WORDS = (
    "the and for with this that from have not are was you all can has more will one about out get use new also any may use see only "
    "user name file path home data lib src main test index page image config default value type string list table view model service "
    "server client local public private static common core util tool build release version project package module class method function "
    "http https www com org net html json xml yaml python java script node docker linux windows admin system content document text number "
    "time date year month group order item product price city state country language english message email address phone account"
).split()

KEY_BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", re.S)
LONG = re.compile(rf"[^\s\"'`<>()\[\]{{}},;|#$&*%!?]{{{MIN_LENGTH},}}")
ASSIGNED = re.compile(rf"[:=]\s*[\"'`]?([^\s\"'`<>,;#]{{{MIN_VALUE},}})")
NAME_BEFORE = re.compile(r"([\w.-]+)[\"'`]?\s*[:=]+\s*[\"'`]?$")


@dataclass
class Candidate:
    start: int
    end: int
    kind: str


def candidates(text: str) -> list[Candidate]:
    """Candidate spans in code points, in order; of overlapping ones the first, longest stays."""
    found = [(m.start(), m.end(), "key block") for m in KEY_BLOCK.finditer(text)] if "-----BEGIN" in text else []
    for m in LONG.finditer(text):
        a, b = m.span()
        cut = text.rfind("=", a, b - 1)
        if cut >= 0 and text[cut + 1 : b].strip("="):
            a = cut + 1
        while b > a and text[b - 1] in ".:-/":
            b -= 1
        token = text[a:b]
        if token.startswith(PREFIXES):
            found.append((a, b, "service key"))
        elif b - a >= MIN_LENGTH and any(c.isdigit() for c in token) and any(c.isalpha() for c in token):
            found.append((a, b, "long string"))
    if "=" in text or ":" in text:
        for m in ASSIGNED.finditer(text):
            a, b = m.span(1)
            name = NAME_BEFORE.search(text, max(0, a - CONTEXT), a)
            if name and SECRET_NAMES.search(name[1]):
                found.append((a, b, "assigned value"))
    out: list[Candidate] = []
    for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or a >= out[-1].end:
            out.append(Candidate(a, b, kind))
    return out


def char_class(text: str) -> np.ndarray:
    """Letters a to z as 0 to 25, digits 26, all else 27; one code for each UTF-8 byte."""
    return CLASS_OF[np.frombuffer(text.encode(), np.uint8)]


CLASS_OF = np.full(256, 27, np.int64)
for _i, _c in enumerate(string.ascii_lowercase):
    CLASS_OF[ord(_c)] = CLASS_OF[ord(_c.upper())] = _i
CLASS_OF[48:58] = 26
CLASSES = 28


def pair_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of neighbouring character classes over all documents (28 x 28)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    c = char_class(text)
                    total += np.bincount(c[:-1] * CLASSES + c[1:], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["pair", "n"])

    rows = docs.select(text_col).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES * CLASSES)
    for r in rows:
        counts[r.pair] = r.n
    return counts.reshape(CLASSES, CLASSES)


def transition_logs(counts: np.ndarray) -> np.ndarray:
    """Log probability of the next character class, smoothed."""
    smooth = counts + 1 + counts.sum() * 1e-6
    return np.log(smooth / smooth.sum(axis=1, keepdims=True))


def coverage(token: str) -> float:
    """Share of the letters that common words cover, longest word first."""
    low, at, covered = token.lower(), 0, 0
    letters = sum(c.isalpha() for c in low)
    while at < len(low):
        size = next((n for n in range(12, 2, -1) if low[at : at + n] in KNOWN), 0)
        covered += size
        at += size or 1
    return covered / letters if letters else 0.0


KNOWN = frozenset(WORDS)


def features(text: str, c: Candidate, logs: np.ndarray) -> list[float]:
    token = text[c.start : c.end]
    before, after = text[max(0, c.start - CONTEXT) : c.start], text[c.end : c.end + CONTEXT]
    size = len(token)
    counts = Counter(token)
    entropy = -sum(n / size * math.log2(n / size) for n in counts.values())
    codes = char_class(token)
    likely = float(logs[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0
    digits, upper, lower = (sum(map(f, token)) / size for f in (str.isdigit, str.isupper, str.islower))
    kinds = [26 if x.isdigit() else 1 if x.isupper() else 2 if x.islower() else 3 for x in token]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / size
    name = NAME_BEFORE.search(before)
    near = before[-24:] + " " + after[:12]
    return [
        math.log(len(token)), entropy, likely, coverage(token), digits, upper, lower, changes, len(counts) / size,
        float(all(x in string.hexdigits for x in token)), float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", token))),
        (token.count("/") + token.count("\\") + token.count(".")) / size, float("://" in token or before.endswith("://") or "www." in token or "@" in token),
        float(bool(SECRET_NAMES.search(before))), float(bool(name and SECRET_NAMES.search(name[1]))), float(bool(OTHER_NAMES.search(before[-32:]))),
        float(bool(name)), float(before[-1:] in "\"'`" and bool(before)), float(bool(PLACEHOLDER.search(token))), float(bool(PLACEHOLDER.search(near))),
        float(token.startswith(PREFIXES)), float(c.kind == "key block"), (token.count("-") + token.count("_")) / size,
    ]


def labelled_findings(count: int = 4000, seed: int = 11) -> list[tuple[str, Candidate, int]]:
    """``(text, candidate, is secret)``: strings of known kinds in usual surroundings."""
    rng = random.Random(seed)
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    sentence = lambda: " ".join(draw("etaoinshrdlu", rng.randint(2, 9)) for _ in range(rng.randint(2, 7)))
    name = lambda: rng.choice(["token", "api_key", "apikey", "secret", "password", "passwd", "access_key", "client_secret", "AUTH_TOKEN", "db_password", "private_key", "bearer"])
    assign = lambda n, v: rng.choice([f'{n} = "{v}"', f"{n}={v}", f"{n}: {v}", f"'{n}': '{v}'", f'"{n}":"{v}"', f"{n} = {v}", f"export {n.upper()}={v}"])
    value = lambda: rng.choice([lambda: draw(hexa, rng.choice([32, 40, 48, 64])), lambda: draw(alnum, rng.randint(16, 48)), lambda: draw(alnum + "+/", rng.randint(20, 64)) + "=", lambda: draw(alnum + "-_", rng.randint(16, 40)), lambda: draw(alnum + "!@%^*", rng.randint(8, 16))])()
    service = lambda: rng.choice(["AKIA" + draw(string.ascii_uppercase + string.digits, 16), "ghp_" + draw(alnum, 36), f"xoxb-{draw(string.digits, 11)}-{draw(alnum, 24)}", "sk_live_" + draw(alnum, 24), "AIza" + draw(alnum + "-_", 35), "glpat-" + draw(alnum, 20), f"eyJ{draw(alnum, 20)}.eyJ{draw(alnum, 40)}.{draw(alnum + '-_', 43)}"])
    word = lambda: rng.choice(WORDS)
    path = lambda: "/".join([word() for _ in range(rng.randint(3, 6))]) + rng.choice([".html", ".py", "", f"-{rng.randint(1, 999)}.json", f"/v{rng.randint(1, 9)}"])
    dummy = lambda: rng.choice(["your_api_key_here1", "xxxxxxxxxxxxxxxx1234", "EXAMPLEKEY1234567890", "changeme1234567890ab", "<your_token_1>aaaaaaaa", "test-token-1234567890", "${API_TOKEN_V1}aaaaaaa", "sample_password_0001"])
    identifier = lambda: "_".join(word() for _ in range(rng.randint(3, 5))) + str(rng.randint(1, 99))
    true = [
        (lambda v: assign(name(), v), value), (lambda v: assign(name(), v), value), (lambda v: assign(name(), v), service), (lambda v: v, service),
        (lambda v: f"Authorization: Bearer {v}", value), (lambda v: f"login {word()} password {v}", lambda: draw(alnum, 20)),
        (lambda v: v, lambda: f"-----BEGIN RSA PRIVATE KEY-----\n{draw(alnum + '+/', 400)}\n-----END RSA PRIVATE KEY-----"),
    ]
    other = lambda: rng.choice(["commit", "sha1", "sha256", "md5", "checksum", "revision", "etag", "build", "uuid"])
    false = [
        (lambda v: rng.choice([f"{other()} {v}", assign(other(), v), f"{other()}: {v}"]), lambda: draw(hexa, rng.choice([32, 40, 64]))),
        (lambda v: v, lambda: str(uuid.UUID(int=rng.getrandbits(128)))), (lambda v: assign("id", v), lambda: str(uuid.UUID(int=rng.getrandbits(128)))),
        (lambda v: rng.choice([f"https://{v}", f"see {v}", f"/{v}"]), lambda: f"www.{word()}.com/{path()}{rng.randint(1, 99)}"),
        (lambda v: v, path), (lambda v: v, identifier), (lambda v: assign(name(), v), dummy), (lambda v: assign(name(), v), lambda: f"os.environ.{word()}1.{word()}"),
        (lambda v: v, lambda: "".join(draw("etaoinshrdlu", rng.randint(3, 7)) for _ in range(4)) + str(rng.randint(1, 9))),
        (lambda v: f"data:image/png;base64 {v}", lambda: "iVBORw0KGgo" + draw(alnum + "+/", 80)), (lambda v: v, lambda: f"{draw('etaoins', 6)}.{rng.randint(0, 99)}@mail{rng.randint(1, 9)}.example.com"),
        (lambda v: v, lambda: f"{rng.randint(2000, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}:30:00.000Z"),
        (lambda v: f"{word()} {v}", lambda: draw(hexa, rng.choice([32, 40]))),
    ]
    out = []
    while len(out) < count:
        label = len(out) % 2
        wrap, make = rng.choice(true if label else false)
        token = make()
        text = f"{sentence()} {wrap(token)}{rng.choice(['', '.', ' ', '###'])} {sentence()}"
        at = text.rfind(token)
        kind = "key block" if token.startswith("-----") else "service key" if token.startswith(PREFIXES) else "long string"
        out.append((text, Candidate(at, at + len(token), kind), label))
    return out


class Forest:
    """Random forest of Gini trees on bootstrap samples; trees are arrays of nodes."""

    def __init__(self, trees: int = 40, depth: int = 12, tried: int = 6, cuts: int = 24, seed: int = 3):
        self.trees, self.depth, self.tried, self.cuts, self.seed = trees, depth, tried, cuts, seed
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        for _ in range(self.trees):
            rows = rng.integers(0, len(x), len(x))
            feature, cut, right, value = [], [], [], []

            def grow(rows: np.ndarray, depth: int) -> None:
                at = len(feature)
                feature.append(-1), cut.append(0.0), right.append(-1), value.append(float(y[rows].mean()))
                best = self.split(x[rows], y[rows], rng) if depth and 0 < value[at] < 1 and len(rows) > 3 else None
                if best:
                    feature[at], cut[at] = best
                    left = x[rows, best[0]] <= best[1]
                    grow(rows[left], depth - 1)
                    right[at] = len(feature)
                    grow(rows[~left], depth - 1)

            grow(rows, self.depth)
            self.nodes.append((np.array(feature), np.array(cut), np.array(right), np.array(value)))
        return self

    def split(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[int, float] | None:
        best, size = None, len(y)
        lowest = y.mean() * (1 - y.mean()) - 1e-9
        for f in rng.choice(x.shape[1], self.tried, replace=False):
            values = np.unique(x[:, f])
            if len(values) < 2:
                continue
            mids = (values[:-1] + values[1:]) / 2
            if len(mids) > self.cuts:
                mids = rng.choice(mids, self.cuts, replace=False)
            left = x[:, f][:, None] <= mids
            n = left.sum(axis=0)
            ones = (left & (y[:, None] == 1)).sum(axis=0)
            a, b = ones / np.maximum(n, 1), (y.sum() - ones) / np.maximum(size - n, 1)
            impurity = (n * a * (1 - a) + (size - n) * b * (1 - b)) / size
            k = int(impurity.argmin())
            if impurity[k] < lowest:
                lowest, best = impurity[k], (int(f), float(mids[k]))
        return best

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean vote of the trees for each row."""
        total = np.zeros(len(x))
        for feature, cut, right, value in self.nodes:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                goes_left = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(goes_left, at + 1, right[at]), at)
            total += value[at]
        return total / max(len(self.nodes), 1)


@dataclass
class Model:
    logs: np.ndarray
    forest: Forest

    def judge(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """``(start, end, kind, score)`` of each candidate, offsets in code points."""
        found = candidates(text) if text else []
        if not found:
            return []
        scores = self.forest.predict(np.array([features(text, c, self.logs) for c in found]))
        return [(c.start, c.end, c.kind, float(s)) for c, s in zip(found, scores)]


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Forest on the labelled findings, with the character transitions of all documents."""
    logs = transition_logs(pair_counts(docs, text_col))
    findings = labelled_findings()
    x = np.array([features(t, c, logs) for t, c, _ in findings])
    return Model(logs, Forest().fit(x, np.array([label for _, _, label in findings])))


def findings_column(text: Column, model: Model) -> Column:
    """Candidates of a text as an array of ``(start, end, kind, score)``; empty for null."""

    @F.pandas_udf("array<struct<start:long,end:long,kind:string,score:double>>")
    def secrets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("start", "end", "kind", "score")
        for texts in batches:
            yield pd.Series([[dict(zip(names, f)) for f in model.judge(t)] for t in texts], dtype=object)

    return secrets.asNondeterministic()(text)


def secret_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each candidate: id, start, end (code points), kind, score, is_secret.

    Null and empty texts have none. Repeated rows each give their findings. Texts and strings of any
    length are read whole; of overlapping candidates the earliest stays, of those that begin
    together the longest. An empty table gives an empty table. Other columns are not read. The
    strings themselves are not returned.
    """
    found = docs.select(id_col, findings_column(F.col(text_col), train(docs, text_col)).alias("found"))
    rows = found.select(id_col, F.explode("found").alias("f")).select(id_col, "f.*")
    return rows.withColumn("is_secret", F.col("score") >= CUT)


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns; confirmed secrets in the text are replaced by a mask.

    A column ``n_chars`` is brought up to date where a text changed. Null texts stay null, empty
    texts empty; texts of any length are read whole; repeated rows are masked alike; an empty table
    stays empty.
    """
    model = train(docs, text_col)

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for text in texts:
                for start, end, _, score in reversed(model.judge(text)):
                    if score >= CUT:
                        text = text[:start] + MASK + text[end:]
                out.append(text)
            yield pd.Series(out, dtype=object)

    name = fresh(docs, "masked_text")
    out = docs.withColumn(name, mask.asNondeterministic()(F.col(text_col)))
    for column in docs.columns:
        if column.lower() == "n_chars":
            kind = docs.schema[column].dataType
            changed = F.col(name) != F.col(text_col)
            out = out.withColumn(column, F.when(changed, F.length(name).cast(kind)).otherwise(F.col(column)))
    return out.withColumn(text_col, F.col(name)).select(*docs.columns)
