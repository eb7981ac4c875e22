"""Secret scans: the base kinds by their definition, and what the lexing adds."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from driftwood.llm import secrets

S = "q7Xw2Lk9Zt41"


def plain_base(text: str) -> list[tuple[int, int, str]]:
    """The base kinds word for word: leftmost matches, the failing ones dropped."""
    out = [(m.start(), m.end(), "assign") for m in re.finditer(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m.group(2)) >= 8]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def added(text: str) -> set[str]:
    return {text[a:b] for a, b, kind, _ in secrets.spans(text) if kind == "literal"}


@pytest.mark.parametrize(
    "text",
    [
        f'db.pwd = "{S}"', f"privateKey: '{S}'", f'{{"clientCredential": "{S}", "n": 1}}', f'conf["passphrase"] = "{S}"', f'passphrase: str = "{S}"', f"run --signing-key {S} now", f'user.setPassphrase("{S}")', f'set("credential", "{S}")',
        f"<passphrase>{S}</passphrase>", f"postgres://app:{S}@db.local/x", f"export SERVICE_KEY={S}", f'pwd := "{S}"', f'if pwd == "{S}": pass', f'headers = {{ Authorization => "{S}" }}', f'pwd = f"{S}"',
        f'A = "{S}"\nB = A\nlogin_credential = B', f'base = "{S}"\npwd = base + "tail"', f'base = "{S}"\nurl = "x"\nbearer = "${{base}}/v"', f"part: {S}\nother: 1\npwd: $part\npassphrase = part", f'k="{S}"\npwd=k+"x"', f"don't stop, dogs' tails; pwd='{S}'",
    ],
)
def test_literals_that_end_up_in_sensitive_names(text):
    assert S in added(text)


@pytest.mark.parametrize(
    "text",
    [
        f'name = "{S}"', f'key_id = "{S}"', f'max_pwd_len = "{S}"', 'pwd = "changeme12"', 'pwd = "${SECRET_9}"', 'pwd = os.getenv("DB_PASS_1")', "pwd: please ask the owner", 'pwd = "your-password-1"', "the key: none of it 1234567",
        f'a = "{S}"\na = "plain"\npwd = a', "http://host:8080/x@y", f"= '{S}'", f'pwd = f("{S}")', "--pwd", "pwd =", 'pwd = "unclosed',
    ],
)
def test_literals_that_are_no_secrets(text):
    assert not added(text)


def test_base_kinds_as_defined(spark):
    rng = random.Random(5)
    parts = ["token", "Token", "api_key", "APIKEY", "paſſword", "password", "=", ":", " ", '"', "'", "abcdefgh", "a1b2c3d4", "AKIA", "QWERTYUIOPAS", "deadbeef", "0123456789abcdef", "0123456789abcdef", "é", "😀", "\n", "secret", "+/=", "zz"]
    texts = [None, "", " ", "token=secret=abcdefgh12", "token=token: abcdefgh1", "x" * 50_000 + "token : '12345678'", *("".join(rng.choices(parts, k=rng.randrange(1, 60))) for _ in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumns({"secrets": F.lit("clash"), "start": F.lit(1)})
    df = df.unionByName(df.where("doc_id = 3"))
    out = secrets.find(df).collect()
    assert len(out) == len(texts) + 1 and all(r["start"] == 1 for r in out)
    for r in out:
        base = [(s["start"], s["end"], s["kind"]) for s in r["secrets"] if s["kind"] != "literal"]
        assert base == plain_base(r["text"] or "")
        assert all(s["score"] >= secrets.MIN_SCORE for s in r["secrets"])
    assert secrets.find(df.limit(0)).count() == 0
    assert plain_base(texts[3])[0][:2] == (0, 23) and plain_base(texts[4]) == []


def test_digests_of_the_query(spark, tmp_path):
    texts = ["password=abcdefgh1 and AKIA" + "Q" * 16, "no", None, f'pwd = "{S}"']
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in secrets.op11_secret_scan(spark, f"file://{tmp_path}").collect()}
    assert out[0]["spans"] == "assign:0:18,access:23:43" and (out[0]["n_assign"], out[0]["n_access"], out[0]["n_hex"]) == (1, 1, 0)
    assert out[0]["base_sha256"] == hashlib.sha256(out[0]["spans"].encode()).hexdigest()
    assert out[1]["base_sha256"] == out[2]["base_sha256"] == out[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert out[3]["spans"] == f"literal:7:{7 + len(S)}"


@pytest.mark.parametrize("text", ["\\'" * 60_000 + " pwd", "pwd = '" * 20_000, 'a = a + "x1"\n' * 20_000 + "pwd = a", "a = a + a\n" * 20_000 + "pwd = a", "pwd" + " " * 100_000 + "= 1", "token" * 30_000, '"' * 100_001 + "pwd", "pwd=" * 50_000, "a=1 " * 50_000 + "pwd=a"])
def test_long_texts_take_linear_time(text):
    import time

    began = time.process_time()
    secrets.spans(text)
    assert time.process_time() - began < 5


#: The words of sensitive names, one after the other, and names in which the short ones stand.
NAMES = "password passwd passphrase passcode pwd secret secrets credential credentials api_key privateKey signing-key encryption_key apikey token bearer authorization authtoken pass pat salt signature auth cookie session otp pin key".split()
NAMES += ["userPin", "USER_PIN", "pinValue", "gh-pat", "otpCode", "myOtp", "my.pat", "Set-Cookie", "éclair_pin", "pin_é", "SessionKey"]


def test_every_sensitive_name_is_looked_at(spark):
    names = NAMES + [n.upper() for n in NAMES[:25]]
    assert all(secrets.name_score(n) >= 0.7 for n in names), [n for n in names if secrets.name_score(n) < 0.7]
    texts = [f'{n} = "Zx81kQw92Lm4Rt7yBv35"' for n in names] + ["<pin>Zx81kQw92Lm4Rt7yBv35</pin>", "run --otp Zx81kQw92Lm4Rt7yBv35"]
    rows = secrets.find(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), keep=["i"]).collect()
    for r in rows:
        assert [tuple(s) for s in r["secrets"]] == secrets.spans(texts[r["i"]]), texts[r["i"]]
        assert r["secrets"], texts[r["i"]]
