"""Secrets in documents, false positives removed by a random forest.

Patterns propose candidates: runs of key characters, what stands before the ``@``
of an address with ``://``, and values that are assigned to a telling name,
however long or short.  Features of the candidate (length, kinds of
characters and their transitions, how much of it dictionary words cover), of the
words beside it and of the document's path go to a forest of decision trees,
trained in numpy from labelled findings.

``fit_table`` learns from a table of labelled findings, with the columns of
``LABELLED``.  The tables of this repository hold none, so the query learns from
``example_findings``, a fixed set of well-known forms: keys and tokens in
assignments on one side; hashes, ids, numbers, addresses, paths, names and
placeholders on the other.  How well forms are judged that the forest hasn't seen
is measured by leaving out each form in turn (``tests/llm``, README).
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, rows

#: A candidate: a run of at least 16 key characters with a digit in it, or in which capitals follow small letters twice.
CANDIDATE = re.compile(r"(?<![\w+/.@-])(?=[A-Za-z_+/.=-]*[0-9]|[A-Z_+/.=-]*[a-z][a-z_+/.=-]*[A-Z][A-Z_+/.=-]*[a-z][a-z_+/.=-]*[A-Z])[A-Za-z0-9_+/.-]{16,}={0,2}(?![\w+/@])")
#: A password, or a user alone, before the host of an address.
LOGIN = re.compile(r"://(?:[^\s/:@\"'`<>]*+:)?+([^\s/\"'`<>]+)@")
#: A name to which something is assigned, and a value: in quotes, or up to white space or a separator.
NAMED = re.compile(r"(?<![\w-])([\w-]++)[\"'`]?[ \t]*+(?:=>|:=|==?|:)[ \t]*+(?:(?:[Bb]earer|[Bb]asic)[ \t]++)?+")
VALUE = re.compile(r"\"([^\"\n]++)\"|'([^'\n]++)'|`([^`\n]++)`|([^\s\"'`,;]++)")
#: Characters looked at on either side for neighbouring words.
BESIDE = 48
HINTS = ("key", "secret", "token", "password", "passwd", "pwd", "auth", "bearer", "credential", "private", "access", "apikey")
HINT = re.compile("|".join(HINTS), re.IGNORECASE)
DOUBTS = ("example", "sample", "dummy", "test", "hash", "sha", "sha1", "sha256", "md5", "commit", "checksum", "uuid", "digest", "id", "version", "revision", "placeholder", "isbn", "serial")
PATH_DOUBTS = ("test", "example", "doc", "fixture", "sample", "mock", "vendor")
TREES, DEPTH, LEAF = 31, 9, 3
#: Labelled findings: a candidate, the text on both sides of it, the path of its document, and whether it is a secret.
LABELLED = "candidate string, before string, after string, path string, is_secret boolean"
#: Labelled findings that are learned from, drawn by a hash where there are more.
MOST_LABELLED = 50_000
FINDINGS = "doc_id long, start long, length int, probability double, is_secret boolean"


@dataclass(frozen=True)
class Finding:
    """A candidate with the text on both sides of it and the path of its document."""

    candidate: str
    before: str = ""
    after: str = ""
    path: str = ""


class Dictionary:
    """Words that ordinary text is made of."""

    def __init__(self, words: list[str]) -> None:
        self.words = ahocorasick.Automaton()
        for w in words:
            self.words.add_word(w, len(w))
        self.words.make_automaton()

    def coverage(self, text: str) -> float:
        """Share of ``text`` that dictionary words cover."""
        covered = np.zeros(len(text), bool)
        for end, size in self.words.iter(text.lower()) if len(self.words) else ():
            covered[end - size + 1 : end + 1] = True
        return float(covered.mean()) if len(text) else 0.0


def dictionary(tokenizer: str) -> Dictionary:
    """The whole words of at least four letters in a public vocabulary."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer).get_vocab()
    return Dictionary(sorted(w[:-4] for w in vocabulary if w.endswith("</w>") and len(w) >= 8 and w[:-4].isalpha() and w.isascii()))


@functools.cache
def _worker_dictionary(tokenizer: str) -> Dictionary:
    """The worker's own dictionary, kept for as long as the worker lives."""
    return dictionary(tokenizer)


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def features(f: Finding, known: Dictionary) -> list[float]:
    """The numbers that the trees see."""
    s = f.candidate
    n = len(s)
    kinds = [_kind(c) for c in s]
    share = [kinds.count(k) / n for k in range(4)]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n
    pairs = Counter(zip(s, s[1:], strict=False))
    counts = Counter(s)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    repeats = sum(a == b for a, b in zip(s, s[1:], strict=False)) / n
    steps = sum(abs(ord(a) - ord(b)) == 1 for a, b in zip(s, s[1:], strict=False)) / n
    before = f.before[-BESIDE:].lower()
    words = re.findall(r"[a-z0-9]+", before)[-3:]
    joined = "".join(words)
    assigned = bool(re.search(r"[=:]\s*[\"'`]?$", before))
    after = re.findall(r"[a-z0-9]+", f.after[:BESIDE].lower())[:2]
    return [
        n, *share, changes, entropy, entropy / math.log2(max(2, n)), len(pairs) / max(1, n - 1), repeats, steps,
        all(c in "0123456789abcdefABCDEF" for c in s), s.count("-") / n, s.count(".") / n, s.count("/") / n, known.coverage(s),
        any(h in joined for h in HINTS), any(w in DOUBTS for w in words), any(w in DOUBTS for w in after), assigned,
        before.rstrip(" ")[-1:] in ("\"", "'", "`"), any(d in f.path.lower() for d in PATH_DOUBTS), any(d in s.lower() for d in ("example", "xxxx", "your", "changeme", "dummy")),
    ]


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), threshold, the two children, and the leaf's share of secrets."""

    feature: np.ndarray
    threshold: np.ndarray
    children: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees, for each row."""
        at = np.tile(self.roots[:, None], (1, len(x)))
        row = np.arange(len(x))
        for _ in range(DEPTH + 1):
            f = self.feature[at]
            go = x[row, np.maximum(f, 0)] > self.threshold[at]
            at = np.where(f < 0, at, self.children[at, go.astype(np.int64)])
        return self.value[at].mean(axis=0)


def grow(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Forest:
    """A forest of Gini trees on bootstrap samples, each split among random features."""
    rng = np.random.default_rng(seed)
    nodes: list[list] = []
    tries = max(1, int(math.sqrt(x.shape[1])) + 1)

    def split(rows_: np.ndarray, depth: int) -> int:
        me = len(nodes)
        share = float(y[rows_].mean())
        nodes.append([-1, 0.0, (me, me), share])
        if depth == DEPTH or len(rows_) < 2 * LEAF or share in (0.0, 1.0):
            return me
        best = (1e-9, -1, 0.0)
        n, parent = len(rows_), share * (1 - share)
        for f in rng.permutation(x.shape[1])[: 2 * tries].tolist():
            order = rows_[np.argsort(x[rows_, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            k = np.arange(1, n)
            ok = (v[1:] > v[:-1]) & (k >= LEAF) & (n - k >= LEAF)
            if not ok.any():
                continue
            left, right = ones[:-1] / k, (ones[-1] - ones[:-1]) / (n - k)
            gain = np.where(ok, parent - (k * left * (1 - left) + (n - k) * right * (1 - right)) / n, -1)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                between = float(v[i] + v[i + 1]) / 2
                best = (float(gain[i]), f, between if between < v[i + 1] else float(v[i]))
        _, f, threshold = best
        if f >= 0:
            go = x[rows_, f] > threshold
            nodes[me][0], nodes[me][1] = f, threshold
            nodes[me][2] = (split(rows_[~go], depth + 1), split(rows_[go], depth + 1))
        return me

    roots = [split(np.sort(rng.integers(0, len(x), len(x))), 0) for _ in range(TREES)]
    feature, threshold, children, value = zip(*nodes, strict=True)
    return Forest(np.array(feature), np.array(threshold), np.array(children), np.array(value), np.array(roots))


def fit(findings: list[tuple[Finding, bool]], known: Dictionary) -> Forest:
    """A forest from labelled findings."""
    return grow(np.array([features(f, known) for f, _ in findings], float), np.array([float(y) for _, y in findings]))


def fit_table(df: DataFrame, known: Dictionary, most: int = MOST_LABELLED) -> Forest:
    """A forest from a table of labelled findings (``LABELLED``), at most ``most`` of them.

    Rows without a candidate or a label are left out, other nulls are empty texts;
    repeated rows count as often as they occur, other columns are ignored.  Fewer
    than two rows, or rows of one label alone, are an error.
    """
    rows_ = df.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in LABELLED.split(", ")]).where("candidate <> '' AND is_secret IS NOT NULL")
    n = rows_.count()
    drawn = rows_ if n <= most else rows_.orderBy(F.xxhash64("candidate", "before", "after", "path"), "candidate", "before", "after", "path").limit(most)
    found = [(Finding(r["candidate"], r["before"] or "", r["after"] or "", r["path"] or ""), r["is_secret"]) for r in drawn.collect()]
    if len({y for _, y in found}) < 2:
        raise ValueError("labelled findings must hold secrets and others")
    return fit(sorted(found, key=str), known)


def example_findings(each: int = 60, seed: int = 5) -> list[tuple[Finding, bool]]:
    """The fixed labelled set."""
    return [(f, y) for _, f, y in example_forms(each, seed)]


def example_forms(each: int = 60, seed: int = 5) -> list[tuple[str, Finding, bool]]:
    """``each`` findings of every form below, with the name of the form and whether they are secrets."""
    rng = np.random.default_rng(seed)
    digits, lower, upper, hexa = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    one = lambda *options: options[int(rng.integers(len(options)))]
    syllables = [c + v + e for c in "bdfgklmnprst" for v in "aeiou" for e in ("", "n", "r", "st")]
    word = lambda: "".join(rng.choice(syllables, int(rng.integers(1, 4))))
    text = lambda n: " ".join(word() for _ in range(n))
    name = lambda: one("token", "api_key", "secret", "password", "auth_token", "access_key", "private_key", "client_secret", "API_KEY", "TOKEN", "Secret")
    assign = lambda: text(3) + " " + name() + one(" = \"", ": \"", "=", " = '", ": ", " = ", "=\"")
    path = lambda: one("lib/core", "app/config", "server", "web/main", "notes", "")
    shift = lambda s: s.upper() if rng.random() < 0.2 else s
    password = lambda: pick(lower + upper + one("", digits, digits + "!$%&*#?+-_"), int(rng.integers(8, 16)))
    login = lambda: text(2) + one(" postgres", " mysql", " https", " amqp", " redis", " url=mongodb", " \"ftp") + "://" + one(word(), "root", "admin", "") + ":"
    secrets = [
        lambda: shift(pick(hexa, 40)), lambda: shift(pick(hexa, 32)), lambda: pick(hexa, 64), lambda: "AKIA" + pick(upper + digits, 16), lambda: "ghp_" + pick(lower + upper + digits, 36),
        lambda: "sk-" + pick(lower + upper + digits, 48), lambda: "xoxb-" + pick(digits, 11) + "-" + pick(lower + upper + digits, 24), lambda: pick(lower + upper + digits + "+/", int(rng.integers(24, 64))) + one("", "=", "=="),
        lambda: pick(lower + upper + digits, int(rng.integers(20, 40))),
        lambda: ".".join("eyJ" + pick(lower + upper + digits + "_-", int(rng.integers(60, 800))) for _ in range(2)) + "." + pick(lower + upper + digits + "_-", 43),
        lambda: pick(lower + upper + digits + "+/", int(rng.integers(500, 2400))) + one("", "=", "=="), password,
    ]
    clean = [
        (lambda: pick(hexa, 40), lambda: text(3) + one(" commit ", " revision ", " sha1 ", " checksum ", " hash: ")),
        (lambda: pick(hexa, 64), lambda: text(2) + one(" sha256:", " digest ", " checksum = ")),
        (lambda: "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: text(3) + one(" ", " uuid ", " id: ")),
        (lambda: pick(digits, int(rng.integers(16, 21))), lambda: text(4) + " "),
        (lambda: pick(digits, int(rng.integers(16, 21))), lambda: text(3) + one(" isbn ", " serial ", " id = ")),
        (lambda: ".".join(pick(digits, 3) for _ in range(4)) + "." + pick(digits, 2), lambda: text(3) + one(" ", " version ")),
        (lambda: "/".join(word() for _ in range(4)) + pick(digits, 2), lambda: text(3) + " "),
        (lambda: "_".join(word() for _ in range(4)) + pick(digits, 1), lambda: text(2) + one(" ", " = ", " key: ")),
        (lambda: "".join(word().capitalize() for _ in range(4)) + pick(digits, 2), lambda: text(3) + " "),
        (lambda: "".join(word() for _ in range(4)) + pick(digits, 3), lambda: text(3) + " "),
        (lambda: word() + "".join(word().capitalize() for _ in range(4)), lambda: text(3) + one(" ", " = ", " def ", " key ")),
        (lambda: one("YOUR_API_KEY_", "EXAMPLE_TOKEN_", "your-secret-here-", "changeme-please-", "dummy_password_") + pick(digits, 4), assign),
        (lambda: one("x", "X", "0", "1") * int(rng.integers(16, 40)) + "1", assign),
        (lambda: "AKIA" + pick(upper, 8) + "EXAMPLE1", assign),
        (lambda: word() + "." + word() + pick(digits, 2) + one(".net", ".org", ".io"), lambda: text(3) + one(" ", " at ", " host ")),
        (lambda: one(word(), word().capitalize(), "true", "null", "none", "None", "string", "required", "undefined"), assign),
        (lambda: one("${", "{{", "$", "<", "%(") + name() + one("}", "}}", "", ">", ")s"), assign),
        (lambda: one("os.environ", "config.get", "process.env", "settings.", "self.") + one("", ".", "(") + name(), assign),
        (lambda: one("git", "www", "anonymous", "user", word()), lambda: text(3) + one(" ssh", " ftp", " https", " git+ssh") + "://"),
        (lambda: pick(lower + upper + digits + "+/", int(rng.integers(200, 2000))), lambda: text(2) + one(" data:image/png;base64,", " data:font/woff;base64,", " payload ", " ")),
        (lambda: "2024-01-" + pick(digits, 2) + "." + pick(digits, 9), lambda: text(3) + " "),
    ]
    out = []
    for _ in range(each):
        for i, s in enumerate(secrets):
            out.append((f"assigned {i}", Finding(s(), assign(), one("\" ", "'", " ", "\n") + text(2), path()), True))
        for i, s in enumerate((password, secrets[0], secrets[8])):
            out.append((f"login {i}", Finding(s(), login(), "@" + word() + one(".com/", ":5432/", ".example.org ") + text(1), path()), True))
        for i, (s, before) in enumerate(clean):
            out.append((f"clean {i}", Finding(s(), before(), one(" ", ".", "\n") + text(2), path()), False))
        out.append(("clean path", Finding(secrets[0](), assign(), "\" " + text(2), one("tests/", "docs/", "examples/", "fixtures/")), False))
    return out


def held_out_forms(known: Dictionary, each: int = 40, least: float = 0.5) -> dict[str, tuple[bool, float]]:
    """For each form whether it is of secrets, and the share judged right by a forest that learned from all others."""
    found = example_forms(each)
    x = np.array([features(f, known) for _, f, _ in found], float)
    y, form = np.array([float(s) for _, _, s in found]), np.array([n for n, _, _ in found])
    out = {}
    for name in dict.fromkeys(form.tolist()):
        own = form == name
        p = grow(x[~own], y[~own]).probability(x[own])
        out[name] = bool(y[own][0]), float(((p >= least) == (y[own] > 0)).mean())
    return out


def candidates(text: str, path: str = "") -> Iterator[tuple[int, Finding]]:
    """Every candidate of ``text`` and where it begins, in order."""
    spans = {m.span() for m in CANDIDATE.finditer(text)}
    spans |= {m.span(1) for m in LOGIN.finditer(text)}
    done = 0
    for name in NAMED.finditer(text):
        # an assignment within a telling one's value is part of that
        if name.end() < done or not HINT.search(name[1]) or not (value := VALUE.match(text, name.end())):
            continue
        start, done = value.span(value.lastindex)
        spans.add((start, done))
        if (cut := text.find("&", start, done)) > start:  # the value of a query
            spans.add((start, cut))
    for start, end in sorted(spans):
        yield start, Finding(text[start:end], text[max(0, start - BESIDE) : start], text[end : end + BESIDE], path)


def scan(df: DataFrame, forest: Forest, tokenizer: str, least: float = 0.5) -> DataFrame:
    """Every candidate in the whole ``text`` of every row (``doc_id``, ``text``, ``source`` as its path).

    ``start`` counts code points; ``is_secret`` tells whether the forest's
    ``probability`` is at least ``least``.  Null and empty texts have no
    candidates, a null ``source`` is an empty path; repeated rows give their
    findings each; a null ``doc_id`` is carried; other columns are ignored; an empty
    table gives no rows.
    """
    sent = df.sparkSession.sparkContext.broadcast(forest)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _worker_dictionary(tokenizer)
        for batch in batches:
            names, starts, found = [], [], []
            for name, text, path in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "source")), strict=True):
                for start, f in candidates(text or "", path or ""):
                    names.append(name)
                    starts.append(start)
                    found.append(f)
            if found:
                p = sent.value.probability(np.array([features(f, known) for f in found], float))
                yield rows(FINDINGS, doc_id=names, start=starts, length=[len(f.candidate) for f in found], probability=p, is_secret=p >= least)

    source = F.col("source") if "source" in df.columns else F.lit(None)
    return map_batches(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), source.cast("string").alias("source")), work, FINDINGS)
