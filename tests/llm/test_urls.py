import math
import random

import numpy as np

from loadlens.llm import urls


def brute_rule(host, path):
    best = None
    for rule, verdict in urls.RULES:
        own, _, rest = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best or (None, None)


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for sign in "?#":
        rest = rest.split(sign, 1)[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def test_rules_and_parts(spark):
    rng = random.Random(1)
    hosts = ["a.example.com", "EXAMPLE.com", "com", "xcom", "x.example.net", "b.org", "É.org", ""]
    paths = ["", "/en/7", "/en/71?x", "/de/8", "/de/9#t", "/es/", "/en", "?en/", "/a://b/c"]
    given = [None, "", "nothing", "http:/x", "x\n://b.org/es/"]
    given += [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(200)]
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(given)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in urls.judged(pages).collect()}
    assert len(got) == len(given)
    for i, u in enumerate(given):
        host, path = brute_parts(u)
        rule, verdict = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict if rule else got[i].verdict in ("allow", "block")
    assert urls.judged(pages.limit(0)).collect() == []


def test_interpolation_against_a_plain_model():
    texts = [b"abcabc", b"abd", b"bcab"]
    _, codes = urls.coded(texts, 2)
    key, n = np.unique(np.concatenate(codes), return_counts=True)
    model = urls.Markov(key, n)
    seen = {}
    for t in texts:
        padded = b"\0\0" + t
        for k in range(3):
            for i in range(2, len(padded)):
                seen.setdefault(padded[i - k : i], []).append(padded[i])
    _, asked = urls.coded([b"abx", b"", b"cab"], 2)
    expected = []
    for t in (b"abx", b"", b"cab"):
        padded = b"\0\0" + t
        for i in range(2, len(padded)):
            p = 1 / 256
            for k in range(3):
                follow = seen.get(padded[i - k : i], [])
                if follow:
                    p = (follow.count(padded[i]) + len(set(follow)) * p) / (len(follow) + len(set(follow)))
            expected.append(math.log(p))
    assert np.allclose(model.log_likelihood(asked), expected)


def test_model_tells_hosts_apart(spark):
    rows = [(i, f"http://{'good' if i % 2 else 'spam'}{i % 9}.example.{'net/de/1' if i % 2 else 'com/en/2'}") for i in range(400)]
    rows += [(1000, "http://good3.example.info/fr/"), (1001, "http://spam3.example.info/fr/")]
    got = {r.page_id: r.verdict for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1000] == "allow" and got[1001] == "block"


def test_contexts_stay_apart_however_many_there_are():
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghijklmnop", k=40)).encode() for _ in range(8000)]
    _, codes = urls.coded(texts)
    for k in range(urls.ORDER + 1):
        padded = [bytes(k) + t for t in texts]
        assert len(np.unique(codes[k] // 256)) == len({p[i : i + k] for p in padded for i in range(len(p) - k)})
    assert len(np.unique(np.concatenate(codes) // 256)) > 1 << 17
