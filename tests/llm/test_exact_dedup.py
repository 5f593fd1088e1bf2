import hashlib
import random
import re
from collections import Counter, defaultdict

from corpuslens.llm import exact_dedup as X


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for i, t in rows:
        k = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        keep = min((x for x in groups[k] if x is not None), default=None)
        out.append((i, keep, len(groups[k]), None if i is None or keep is None else i == keep, hashlib.sha256(k.encode()).hexdigest()))
    return Counter(out)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot text here", "hot \t text\nhere", f"t{rng.randrange(40)} x", "", None, " ", " x", "x" * 50000])) for i in range(600)]
    rows += [(5, "twice"), (5, "twice"), (None, "lone"), (None, None), (7, "lone")]
    df = spark.createDataFrame([(i, t, "k", "d") for i, t in rows], "doc_id long, text string, digest string, keep_id string").repartition(5)
    for counters in (2, 512):
        assert Counter(tuple(r) for r in X.exact_dedup(df, counters).collect()) == brute(rows)
    assert X.exact_dedup(df.limit(0)).count() == 0


def test_hot_digest_is_found(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "unhex(sha2(if(id % 3 = 0, 'hot', string(id)), 256)) as digest").repartition(4)
    assert [bytes(r.digest) for r in X.frequent(df, 4).collect()] == [hashlib.sha256(b"hot").digest()]
