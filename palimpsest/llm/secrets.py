"""Secret scans: candidates from patterns, false positives removed by a random forest.

Candidates are long unbroken runs with a digit, values that follow a name like ``password`` and a sign, what follows
``bearer``, the passwords of addresses (``scheme://user:password@host``) and whole blocks of private keys. Each has
features from its own characters (length, entropy, transitions between kinds of characters, how common its letter
pairs are), from a small dictionary (share of it that words cover), from its shape (a path, a host, an identifier, a
known prefix) and from the neighbouring words. The forest, written in numpy, learns them from labelled findings; by
default from ``example_findings``, which are drawn from stated shapes with a fixed seed and hold no text of any corpus.

Defined cases: null and empty texts have no findings; texts are scanned whole, whatever their length; a secret that
occurs twice is found twice; overlapping candidates count once, key blocks and passwords of addresses before others; a
key block without its last line is no block; repeated rows give repeated findings; an empty table
gives no findings. Redacting keeps all columns and rows.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import string
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import column, text_or_empty

# Names that announce secrets or harmless hashes, prefixes of issued keys, frequent words.
NAMES = "password passwd passphrase pwd secret token apikey api_key api-key accesskey access_key access-key secretkey secret_key secret-key privatekey private_key private-key credential credentials auth_token client_secret bearer".split()
HARMLESS = "sha sha1 sha256 sha512 md5 crc checksum digest hash commit revision rev build uuid guid etag version isbn doi example sample placeholder id ref object blob tree file path url".split()
PREFIXES = tuple("AKIA ASIA ghp_ gho_ ghs_ ghu_ github_pat_ glpat- sk- sk_live_ rk_live_ pk_live_ xoxb- xoxp- xoxa- AIza SG. eyJ npm_ pypi- -----BEGIN".split())
WORDS = "the and for that with this from have not you are was but all can one had her his out they about which when make like time just know take people into year your good some could them see other than then now look only come over think also back after use two how our work first well way even new want because any these give day most get has him would there their what said each she may will down should through where much before right too means old same tell does set three end put home read hand port large spell add land here must big high such follow act why ask men change went light kind off need house picture try again animal point mother world near build self earth father head stand own page country found answer school grow study still learn plant cover food sun four between state keep eye never last let thought city tree cross farm hard start might story saw far sea draw left late run while press close night real life few north open seem together next white children begin got walk example ease paper group always music those both mark often letter until mile river car feet care second book carry took science eat room friend began idea fish mountain stop once base hear horse cut sure watch color face wood main enough plain girl usual young ready above ever red list though feel talk bird soon body dog family direct pose leave song measure door product black short numeral class wind question happen complete ship area half rock order fire south problem piece told knew pass since top whole king space heard best hour better true during hundred five remember step early hold west ground interest reach fast verb sing listen six table travel less morning ten simple several vowel toward war lay against pattern slow center love person money serve appear road map rain rule govern pull cold notice voice unit power town fine certain fly fall lead cry dark machine note wait plan figure star box noun field rest correct able pound done beauty drive stood contain front teach week final gave green quick develop ocean warm free minute strong special mind behind clear tail produce fact street inch multiply nothing course stay wheel full force blue object decide surface deep moon island foot system busy test record boat common gold possible plane stead dry wonder laugh thousand ago ran check game shape equate hot miss brought heat snow tire bring yes distant fill east paint language among user admin config default service index image data value name type file path model server client update delete insert select".split()

NAME = "|".join(sorted(map(re.escape, NAMES), key=len, reverse=True))
#: Bytes of runs; a text is looked at in Latin-1, one byte for each code point, with others than these as gaps.
IN_RUN = np.zeros(256, bool)
IN_RUN[[ord(c) for c in string.ascii_letters + string.digits + "_/+.=-"]] = True
LEAST_RUN = 16
NAMED = re.compile(rf"(?:{NAME})[\"']?[ \t]{{0,4}}$", re.I)
VALUE = re.compile(r"(?:=>|:=|[:=])[ \t]{0,4}([\"']?)([^\s\"',;]{6,})")
BEARER = re.compile(r"[Bb](?:earer|EARER)[ \t]{1,4}([A-Za-z0-9._~+/=-]{16,})")
IN_ADDRESS = re.compile(r"://[^\s:/@]*+:([^\s/@]{6,}+)@")
BLOCK_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY(?: BLOCK)?-----")
BLOCK_END = re.compile(r"-----END (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY(?: BLOCK)?-----")
NAME_END = re.compile(rf"(?:{NAME})[\"'=:> \t]*$", re.I)
WORD = re.compile(r"[A-Za-z][A-Za-z_-]*")
CONTEXT = 48
PAIRS = np.zeros((26, 26))
for _w in WORDS:
    for _a, _b in zip(_w, _w[1:]):  # noqa: B905
        PAIRS[ord(_a) - 97, ord(_b) - 97] += 1
PAIRS = np.log((PAIRS + 0.1) / (PAIRS.sum() / 676 + 0.1))
DICTIONARY = frozenset(w for w in WORDS if len(w) > 3)
FEATURES = ["length", "entropy", "digits", "upper", "lower", "signs", "changes", "pairs", "coverage", "hex", "repeats", "path", "host", "uuid", "prefix", "named", "assigned", "harmless", "quoted"]


def kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """Private keys from their first to their last line; what lies between must be long runs, not prose."""
    ends = [(m.start(), m.end()) for m in BLOCK_END.finditer(text)] if "-----BEGIN" in text else []
    begins = [(m.start(), m.end()) for m in BLOCK_BEGIN.finditer(text)] if ends else []
    k = 0
    for i, (start, body) in enumerate(begins):
        limit = begins[i + 1][0] if i + 1 < len(begins) else len(text)
        while k < len(ends) and ends[k][0] < body:
            k += 1
        if k < len(ends) and ends[k][0] <= limit:
            words = text[body : ends[k][0]].split()
            if sum(map(len, words)) >= LEAST_RUN * max(len(words), 1):
                yield start, ends[k][1]


def candidates(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether a name assigns it), in order and apart."""
    found = []
    sure = sorted([*key_blocks(text), *(m.span(1) for m in IN_ADDRESS.finditer(text))])
    sure = [s for k, s in enumerate(sure) if not k or s[0] >= sure[k - 1][1]]
    data = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    reach = 0  # the end of the last value; one that starts within it ends with it, so it is not read again
    for at in np.flatnonzero((data == 61) | (data == 58)).tolist():
        if NAMED.search(text, max(0, at - 32), at):
            m = VALUE.match(text, at, at + 16 if at < reach else len(text))
            if m and at < reach <= m.start(2):
                m = VALUE.match(text, at)
            if m:
                reach = reach if m.start(2) < reach else m.end(2)
                found.append((m.start(2), reach, True))
    found += [(*m.span(1), False) for m in BEARER.finditer(text)]
    edges = np.flatnonzero(np.diff(IN_RUN[data], prepend=False, append=False))
    for start, end in edges.reshape(-1, 2)[np.diff(edges)[::2] >= LEAST_RUN].tolist():
        run = text[start:end].rstrip("=.-")
        if "=" in run:
            cut = run.rindex("=") + 1
            start, run = start + cut, run[cut:]
        end = start + len(text[start:end].rstrip("."))
        if len(run) >= LEAST_RUN and (any(c in string.digits for c in run) or run.startswith(PREFIXES)):
            found.append((start, end, False))
    out: list[tuple[int, int, bool]] = []
    k = 0
    for start, end, named in sorted(found, key=lambda x: (x[0], not x[2], -x[1])):
        while k < len(sure) and sure[k][1] <= start:
            k += 1
        if (not out or start >= out[-1][1]) and (k == len(sure) or end <= sure[k][0]):
            out.append((start, end, named))
    return sorted([*out, *((start, end, True) for start, end in sure)])


def describe(value: str, before: str, after: str, assigned: bool) -> list[float]:
    n = len(value)
    counts = {c: value.count(c) for c in set(value)}
    kinds = [kind(c) for c in value]
    letters = [ord(c) - 97 for c in value.lower() if "a" <= c <= "z"]
    pairs = float(np.mean(PAIRS[letters[:-1], letters[1:]])) if len(letters) > 2 else -1.0
    low, covered, at = value.lower(), 0, 0
    while at < n:
        size = next((k for k in range(min(9, n - at), 3, -1) if low[at : at + k] in DICTIONARY), 0)
        covered += size
        at += size or 1
    near = [w.lower() for w in WORD.findall(before)[-4:] + WORD.findall(after)[:2]]
    return [
        min(n, 200),
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        kinds.count(0) / n,
        kinds.count(2) / n,
        kinds.count(1) / n,
        kinds.count(3) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,  # noqa: B905
        pairs,
        covered / n,
        float(all(c in string.hexdigits for c in value)),
        max(counts.values()) / n,
        value.count("/") / n + bool(re.search(r"\.[a-z]{2,4}$", value)),
        float(bool(re.match(r"(?:[a-z0-9-]+\.){2,}[a-z]{2,}$|(?:\d+\.){2,}\d+$", value))),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", value))),
        float(value.startswith(PREFIXES)),
        float(bool(NAME_END.search(before)) or any(w in NAMES for w in near)),
        float(assigned),
        float(sum(w in HARMLESS for w in near)),
        float(before[-1:] in ("'", '"')),
    ]


def example_findings(n: int = 4000, seed: int = 7) -> list[tuple[str, str, str, bool, int]]:
    """(value, before, after, assigned, label): labelled findings of known shapes."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    hexa = lambda k: pick("0123456789abcdef", k)
    syllables = [a + b for a in "bcdfghlmnprstvw" for b in ("a", "e", "i", "on", "er", "an", "en", "ing", "th", "st")]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4))) if r.random() < 0.5 else r.choice(WORDS)
    prose = lambda: " ".join(word() for _ in range(r.randint(2, 5))) + " "
    mixed = string.ascii_letters + string.digits
    address = lambda: prose() + r.choice(["postgres", "mysql", "https", "amqp", "redis", "mongodb"]) + "://" + r.choice([word(), "user", "admin", ""]) + ":"
    block = lambda body: "-----BEGIN {0}PRIVATE KEY-----\n{1}\n-----END {0}PRIVATE KEY-----".format(r.choice(["", "RSA ", "EC ", "OPENSSH "]), body)
    secret = [
        lambda: (r.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + r.choice(["234567", "", "0123456789"]), 16), prose(), False),
        lambda: (r.choice(["ghp_", "gho_", "npm_"]) + pick(mixed, 36), prose(), False),
        lambda: (r.choice(["sk-", "sk_live_", "xoxb-", "glpat-", "AIza"]) + pick(mixed, r.randint(20, 40)), prose(), False),
        lambda: (".".join(["eyJ" + pick(mixed, 17), pick(mixed, 40), pick(mixed + "-_", 43)]), prose(), False),
        lambda: (hexa(r.choice([16, 18, 20, 24, 32, 40, 64])), prose() + r.choice(NAMES) + r.choice(["=", ": ", " = ", ' = "', "='"]), True),
        lambda: (pick(mixed + "+/_-", r.randint(14, 44)), prose() + r.choice(NAMES) + r.choice(["=", ": ", ' = "', '": "']), True),
        lambda: (pick(mixed + "!#%&*?", r.randint(8, 14)), prose() + r.choice(["password", "passwd", "pwd"]) + r.choice(["=", ": "]), True),
        lambda: (base64.b64encode(r.randbytes(30)).decode(), prose() + r.choice(NAMES) + " ", False),
        lambda: (pick(string.ascii_letters, r.randint(20, 60)), prose() + r.choice(["Bearer ", "Authorization: Bearer "]), False),
        lambda: (pick(mixed + "!#%&*?", r.randint(8, 24)), address(), True),
        lambda: (r.choice([word(), word().title()]) + r.choice(["", word().title()]) + pick("!#_" + string.digits, r.randint(2, 5)), address(), True),
        lambda: (block("\n".join(pick(mixed + "+/", 64) for _ in range(r.randint(3, 26)))), prose() + r.choice(["", "private_key = ", "key: "]), True),
    ]
    harmless = [
        lambda: (hexa(r.choice([32, 40, 64])), prose() + r.choice(HARMLESS[:15]) + r.choice([" ", ": ", "="]), False),
        lambda: (str(uuid.UUID(bytes=r.randbytes(16))), prose() + r.choice(["", "id "]), False),
        lambda: ("/".join(word() for _ in range(r.randint(3, 6))) + r.choice([".py", ".html", "/v2", str(r.randint(1, 99))]), prose(), False),
        lambda: (pick(string.digits, r.randint(16, 24)), prose(), False),
        lambda: (".".join([word(), word(), "example", r.choice(["com", "org"])]) + "/" + str(r.randint(1, 9999)), prose(), False),
        lambda: ("_".join(word() for _ in range(4)) + str(r.randint(0, 99)), prose(), False),
        lambda: ("".join(word().title() for _ in range(4)) + str(r.randint(0, 9)), prose(), False),
        lambda: (r.choice(["xxxxxxxxxxxxxxxx", "your_api_key_here", "changeme", "********", "placeholder1", "<password>", "${PASSWORD}", "example123", "null", "required", "undefined"]), prose() + r.choice(NAMES) + r.choice(["=", ": "]), True),
        lambda: (word() + r.choice(["", "ed", "ing"]) + word(), prose() + r.choice(["password", "token", "secret"]) + ": ", True),
        lambda: (r.choice(["2024-01-02T03:04:05", "1.2.3.4.5.6.7.8.9", "10.20.30.40/16-20"]) + pick(string.digits, r.randint(2, 8)), prose(), False),
        lambda: ("-".join([word(), word(), word(), str(r.randint(1, 2030))]), prose(), False),
        lambda: (r.choice(["", "-"]).join(word() for _ in range(r.randint(4, 6))), prose() + "bearer ", False),
        lambda: (r.choice(["password", "secret", "changeme", "your_password", "<password>", "${PASSWORD}", "xxxxxxxx", "********", word() + word()]), address(), True),
        lambda: (block(r.choice(["." * 48, "x" * 64, "<your-private-key>", "REDACTED" * 4])), prose(), True),
    ]
    out = []
    for i in range(n):
        value, before, assigned = r.choice(secret if i % 2 else harmless)()
        out.append((value, before, r.choice(['" ', " "]) + prose(), assigned, i % 2))
    return out


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: feature (-1 at leaves), threshold, children, share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for feature, threshold, child, share in self.trees:
            at = np.zeros(len(rows), np.int64)
            while True:
                f = feature[at]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                right = rows[inner, f[inner]] > threshold[at[inner]]
                at[inner] = child[at[inner]] + right
            total += share[at]
        return total / len(self.trees)


def grow(rows: np.ndarray, labels: np.ndarray, r: np.random.Generator, depth: int, tried: int, least: int = 3) -> tuple:
    feature, threshold, child, share = [-1], [0.0], [0], [float(labels.mean())]
    pending = [(0, np.arange(len(rows)), 0)]
    while pending:
        node, at, level = pending.pop()
        y = labels[at]
        if level == depth or len(at) < 2 * least or y.min() == y.max():
            continue
        best = (1e-9, -1, 0.0)
        whole = y.mean() * (1 - y.mean()) * len(y)
        for f in r.choice(rows.shape[1], tried, replace=False):
            order = np.argsort(rows[at, f], kind="stable")
            x, ones = rows[at, f][order], np.cumsum(y[order])
            k = np.arange(1, len(y))
            ok = (x[1:] > x[:-1]) & (k >= least) & (len(y) - k >= least)
            if not ok.any():
                continue
            left, rest = ones[:-1], ones[-1] - ones[:-1]
            impure = left * (k - left) / k + rest * (len(y) - k - rest) / (len(y) - k)
            impure[~ok] = np.inf
            i = int(impure.argmin())
            if whole - impure[i] > best[0]:
                best = (whole - impure[i], int(f), (x[i] + x[i + 1]) / 2)
        if best[1] < 0:
            continue
        right = rows[at, best[1]] > best[2]
        feature[node], threshold[node], child[node] = best[1], best[2], len(feature)
        for part in (at[~right], at[right]):
            feature.append(-1)
            threshold.append(0.0)
            child.append(0)
            share.append(float(labels[part].mean()))
            pending.append((len(feature) - 1, part, level + 1))
    return np.array(feature), np.array(threshold), np.array(child), np.array(share)


def train(findings: Iterable[tuple[str, str, str, bool, int]] | None = None, trees: int = 30, depth: int = 10, seed: int = 11) -> Forest:
    """A forest from labelled findings (value, text before, text after, assigned, 1 for a secret)."""
    found = list(findings) if findings is not None else example_findings()
    rows = np.array([describe(v, b, a, named) for v, b, a, named, _ in found])
    labels = np.array([label for *_, label in found], np.float64)
    r = np.random.default_rng(seed)
    return Forest([grow(rows[at], labels[at], r, depth, 5) for at in (r.integers(0, len(rows), len(rows)) for _ in range(trees))])


def find(texts: list[str], forest: Forest, threshold: float = 0.5) -> list[list[tuple[int, int, float]]]:
    """The secrets of each text: (start, end, score) in code points."""
    whose, spans, rows = [], [], []
    for i, text in enumerate(texts):
        for start, end, named in candidates(text):
            whose.append(i)
            spans.append((start, end))
            rows.append(describe(text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT], named))
    out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    if rows:
        for i, (start, end), score in zip(whose, spans, forest.score(np.array(rows)).tolist(), strict=True):
            if score >= threshold:
                out[i].append((start, end, score))
    return out


def scan(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, start, length, score, secret_sha256): a row for each secret; the secret itself does not leave the text."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)
    arrow = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64()), ("secret_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = column(batch, "id"), column(batch, "text")
            rows = [(i, s, e - s, score, hashlib.sha256(t[s:e].encode()).hexdigest()) for i, t, found in zip(ids, texts, find(texts, sent.value, threshold), strict=True) for s, e, score in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, arrow, strict=True)], schema=arrow)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, start long, length long, score double, secret_sha256 string").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, forest: Forest, mark: str = "[SECRET]", threshold: float = 0.5) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; ``n_chars``, where there is one, follows."""
    sent, names = docs.sparkSession.sparkContext.broadcast(forest), docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            new = list(texts)
            for i, found in enumerate(find([t or "" for t in texts], sent.value, threshold)):
                for start, end, _ in reversed(found):
                    new[i] = new[i][:start] + mark + new[i][end:]
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(new, columns[names.index("text")].type)
            if "n_chars" in names:
                at = names.index("n_chars")
                said = columns[at].to_pylist()
                columns[at] = pa.array([len(b) if a != b else n for a, b, n in zip(texts, new, said, strict=True)], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
