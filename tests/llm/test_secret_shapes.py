import random
import string
import time

from palimpsest.llm import secrets

R = random.Random(5)


def pick(alphabet, k):
    return "".join(R.choice(alphabet) for _ in range(k))


def block(body, kind="RSA "):
    return f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----"


def test_addresses_bearers_and_key_blocks(spark):
    mixed = string.ascii_letters + string.digits
    key = "\n".join(pick(mixed + "+/", 64) for _ in range(12))
    token = pick(string.ascii_letters, 40)
    rows = [
        (1, "see postgres://user:S3cretPass99@db.example.com/x now", "see postgres://user:[SECRET]@db.example.com/x now"),
        (2, f"Authorization: Bearer {token}", "Authorization: Bearer [SECRET]"),
        (3, f"a {block(key)} b {block(key, '')} c", "a [SECRET] b [SECRET] c"),
        (4, f'private_key = "{block(key)}"', 'private_key = "[SECRET]"'),
        (5, "database_password=mysql://root:x9!kQz#71pW@host", "database_password=mysql://root:[SECRET]@host"),
        (6, f"write {block('...')} or {block('the key that you have been given by us')}", None),
        (7, "https://user:password@example.com and mailto://a@b the bearer internationally-acclaimed", None),
        (8, None, None),
        (8, "", None),
    ]
    docs = spark.createDataFrame([(i, t, 3, 4, 5) for i, t, _ in rows], "doc_id long, text string, start int, score int, n_chars int")
    forest = secrets.train()
    out = secrets.redact(docs, forest)
    assert out.columns == docs.columns
    got = sorted((r.doc_id, r.text or "") for r in out.collect())
    assert got == sorted((i, (t if w is None else w) or "") for i, t, w in rows)
    assert secrets.scan(docs.limit(0), forest).count() == 0 and secrets.redact(docs.limit(0), forest).count() == 0
    twice = docs.union(docs)
    assert secrets.scan(twice, forest).count() == 2 * secrets.scan(docs, forest).count() == 12


def test_candidates_are_apart_and_take_linear_time():
    began = time.time()
    for text in ("://a:" * 50_000, "-----BEGIN PRIVATE KEY-----" * 20_000, "-----END PRIVATE KEY-----" * 20_000, "bearer " * 50_000, "://u:" + "p" * 200_000, block("k" * 64) * 5_000):
        found = secrets.candidates(text)
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))  # noqa: B905
    assert time.time() - began < 20
