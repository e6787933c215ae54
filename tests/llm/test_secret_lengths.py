import hashlib
import random
import string

from palimpsest.llm import secrets


def test_named_secrets_of_any_length(spark):
    r = random.Random(3)
    pick = lambda k: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(k))
    values = [pick(511), pick(512), pick(513), pick(803), "eyJ" + pick(200) + "." + pick(900) + "." + pick(342), pick(30_000)]
    docs = spark.createDataFrame([(i, f"the token: {v} ends") for i, v in enumerate(values)], "doc_id long, text string")
    forest = secrets.train()
    got = {x.doc_id: x for x in secrets.scan(docs, forest).collect()}
    for i, v in enumerate(values):
        assert (got[i].start, got[i].length, got[i].secret_sha256) == (11, len(v), hashlib.sha256(v.encode()).hexdigest())
    assert {x.text for x in secrets.redact(docs, forest).collect()} == {"the token: [SECRET] ends"}


def test_values_within_values():
    text = "token=abctoken=0123456789 token=xyztoken= 'abcdef1' " + "token=" * 50_000
    plain = [(m.start(2), m.end(2)) for at, c in enumerate(text[:52]) if c in ":=" and secrets.NAMED.search(text, max(0, at - 32), at) and (m := secrets.VALUE.match(text, at))]
    kept = [s for k, s in enumerate(plain) if all(s[0] >= e for _, e in plain[:k])]
    assert [(s, e) for s, e, named in secrets.candidates(text) if named and s < 52] == kept and len(kept) == 3
