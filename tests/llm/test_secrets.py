import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, secrets

SF = "/root/testdata/sf0.001"


def _brute_base(text):
    """The three patterns, as they are stated, with their lengths tested afterwards."""
    text = text or ""
    kinds = [
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 12),
        ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 18),
        ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 16),
    ]
    found = [(m.start(), i, k, m.end()) for i, (k, p, f, ok) in enumerate(kinds) for m in re.finditer(p, text, f) if ok(m)]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


ODD = ["", None, "AKIA" * 9, "token = token: " + "a" * 40, "é" * 5 + "SECRET: x1y2z3x1y2z3 " + "0" * 16, "password=short api-key=abcdefghijklmnop apikey='abcdefghijkl'", "f" * 15 + "g" + "f" * 16, "token=" * 2000]


def test_base_spans_against_brute_force():
    for t in ODD:
        got = [f"{s[0]}:{s[1]}:{s[2]}" for s in secrets.find_spans(t) if s[0] != "literal"]
        assert got == _brute_base(t)


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op4_secrets(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = _brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]
        assert set(base) <= set(r.spans.split(",")) if base else True


def _literals(text):
    return {text[a:b]: name for kind, a, b, name, _ in secrets.find_spans(text) if kind == "literal"}


def test_constants_are_propagated():
    text = 'KEY_PART = "a8Xk29sLq0"\nother = "Zz8Xk29sLq0"\nclient_secret = KEY_PART + "ef56Gh78zz"\n'
    assert _literals(text) == {"a8Xk29sLq0": "client_secret", "ef56Gh78zz": "client_secret"}
    assert _literals('base: &x\nDB = \'q1W2e3R4t5\'\nexport DB_PASSWORD="${DB}"') == {"q1W2e3R4t5": "DB_PASSWORD"}


def test_syntaxes():
    for text in ('{"db_password": "q1W2e3R4t5"}', "privateKey => 'q1W2e3R4t5'", "auth_key := `q1W2e3R4t5`", "PASSPHRASE=q1W2e3R4t5", "access-key: q1W2e3R4t5"):
        assert list(_literals(text)) == ["q1W2e3R4t5"], text


def test_what_is_no_secret():
    for text in ("max_tokens: 123456789012", "password = changeme123", "password: str = None", "token_type = 'Bearer9x8y7z'", "the secret: being kind", "author = 'q1W2e3R4t5'"):
        assert _literals(text) == {}, text


def test_scan_keeps_rows_and_columns(spark):
    rows = spark.createDataFrame([(1, "token: abcdefghijkl", "x"), (None, None, None), (1, "token: abcdefghijkl", "x")], "id long, text string, secrets string")
    found = secrets.scan(rows)
    assert found.columns == ["id", "text", "secrets"] and sorted(len(r.secrets) for r in found.collect()) == [0, 1, 1]
    assert secrets.scan(rows.limit(0)).count() == 0


def test_redaction(spark):
    rows = spark.createDataFrame([(1, 'a token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" b 0123456789abcdef'), (2, None), (3, "clean")], "id long, text string")
    found = {r.id: r.text for r in secrets.redact(rows).collect()}
    assert found == {1: 'a [SECRET]" b [SECRET]', 2: None, 3: "clean"}
    assert all(not secrets.find_spans(t) for t in found.values())


def test_long_texts_are_scanned_whole():
    text = "word " * 400_000 + "AKIA" + "A1" * 8
    assert [s[:3] for s in secrets.find_spans(text)] == [("access", 2_000_000, 2_000_020)]
    assert F is not None


def test_subscripts_and_declared_types():
    for text in ('config["db_password"] = "q1W2e3R4t5"', "os.environ[ 'API_KEY' ] = 'q1W2e3R4t5'", 'api_key: str = "q1W2e3R4t5"', "const apiKey: string | null = 'q1W2e3R4t5'", 'val apiKey: String? = "q1W2e3R4t5"', "auth_key: Optional[str] = 'q1W2e3R4t5'", 'let token: &\'static str = "q1W2e3R4t5"'):
        assert list(_literals(text)) == ["q1W2e3R4t5"], text
    assert _literals('part: str = "q1W2e3R4t5"\nclient_secret = part') == {"q1W2e3R4t5": "client_secret"}
    assert _literals('part: str = "q1W2e3R4t5"\npassword: str = None') == {}  # a type is no constant
    assert _literals('error: token = "q1W2e3R4t5"') == {"q1W2e3R4t5": "token"}
    assert _literals("api_key: dGhpc2lzYXNl1Y3Jl=") != {}
    secrets.find_spans("token: " + "a" * 200_000 + " a<" * 50_000)
    secrets.find_spans("token: " + "a b " * 100_000 + "token: a[" * 20_000)


def test_names_that_stand_for_literals():
    for text in (
        "client_secret = part\npart = 'q1W2e3R4t5'",
        'DB="q1W2e3R4t5"\nDB_PASSWORD="${DB}"',
        "db = 'q1W2e3R4t5'\nauth_key = f'{db}'",
        "db = 'q1W2e3R4t5'\nauth_key = 'x-%(db)s'",
        "base: &cred q1W2e3R4t5\npassword: *cred",
        "password: *cred\nbase: &cred 'q1W2e3R4t5'",
        "a = 'q1W2e3R4t5'\nb = a\nc = b\nprivate_key = c",
        "a = 'q1W2e3R4t5'\nprivate_key = private_key + a",
        "x = 'q1W2e3R4t5'\nsecret=x+x",
    ):
        assert list(_literals(text)) == ["q1W2e3R4t5"], text
    assert _literals("a = 'q1W2e3R4t5'\na = 'Zz9Yy8Xx7W'\npassword = a\na = 'other1234x'") == {"Zz9Yy8Xx7W": "password"}
    assert _literals('password = "${DB_PASSWORD}"\nsecret: $OTHER_SECRET1') == {}  # names alone
    assert _literals("password = a\na = b\nb = a") == {}


def test_names_and_values_apart():
    for text in (
        "- name: DB_PASSWORD\n  value: q1W2e3R4t5",
        '{"name": "db_password", "value": "q1W2e3R4t5"}',
        '<add key="DbPassword" value="q1W2e3R4t5"/>',
        "<config><db-password>q1W2e3R4t5</db-password></config>",
        '<setting password="q1W2e3R4t5"/>',
        '{"key": "API_KEY", "type": "plain", "value": "q1W2e3R4t5"}',
    ):
        assert list(_literals(text)) == ["q1W2e3R4t5"], text
    assert _literals('{"name": "colour", "value": "q1W2e3R4t5"}') == {}


def _statement(rng, names, i):
    """One assignment, the literals in it, and the names that it refers to."""
    literal = lambda: "".join(rng.choices("abcdefghjkmnpqrstuvwxyzABCDEFGHJKLMN23456789", k=rng.randrange(12, 20))) + "7"
    name = rng.choice(["plain", "other", "item", "db_password", "client_secret", "auth_key", "authToken"]) + f"_{chr(97 + i % 26)}"
    kind = rng.randrange(6)
    if kind == 0:
        return name, f'{name} = "{(x := literal())}"', [x], []
    if kind == 1:
        return name, f"{name}: '{(x := literal())}'", [x], []
    if kind == 2:
        return name, f"{name}={(x := literal())}", [x], []
    other = rng.choice(names)
    if kind == 3:
        return name, f"{name} = {other}", [], [other]
    if kind == 4:
        return name, f'{name} = {other} + "{(x := literal())}"', [x], [other]
    return name, f'export {name}="${{{other}}}"', [], [other]


def test_literals_against_brute_force():
    """Programs made from statements whose parts are known; reachability by plain recursion."""
    for seed in range(300):
        rng = random.Random(seed)
        names = [f"{n}_{c}" for n in ("plain", "other", "item", "db_password") for c in "abcdefghij"]
        program = [_statement(rng, names, i) for i in range(rng.randrange(1, 12))]
        text = "\n".join(rng.choice(["", "  "]) + s[1] for s in program)

        def stands_for(name, at):
            before = [i for i in range(at) if program[i][0] == name]
            after = [i for i in range(at + 1, len(program)) if program[i][0] == name]
            return before[-1] if before else after[0] if after else None

        def reach(i, seen):
            if i in seen:
                return set()
            seen.add(i)
            found = set(program[i][2])
            for name in program[i][3]:
                if (j := stands_for(name, i)) is not None:
                    found |= reach(j, seen)
            return found

        want = set()
        for i, (name, *_) in enumerate(program):
            if any(w in name.lower() for w in ("password", "secret", "auth")):
                want |= {x for x in reach(i, set()) if secrets.randomness(x) * 0.9 >= secrets.THRESHOLD}
        unresolved = {x for i, s in enumerate(program) for x in s[2] if s[3] and stands_for(s[3][0], i) is None}
        assert set(_literals(text)) - unresolved - set(names) == want - unresolved, text


@pytest.mark.parametrize("text", ['password="' + "a=b.c+" * 170_000, "token=" * 170_000, "password = a + " * 70_000, "secret=x+" * 110_000, "token='\\'" * 100_000, "key: <" * 150_000 + "password", "auth_key=example" * 60_000, "a.token: str|" * 70_000, "name=token value=token " * 40_000])
def test_time_is_linear(text):
    secrets.find_spans(text[: len(text) // 50])
    began = time.perf_counter()
    secrets.find_spans(text)
    assert time.perf_counter() - began < 8


def test_clashing_and_repeated(spark):
    rows = spark.createDataFrame([("token: abcdefghijkl", "a", "b")] * 2, "text string, _in_text string, _in_0 string")
    found = secrets.redact(rows)
    assert found.columns == rows.columns and [tuple(r) for r in found.collect()] == [("[SECRET]", "a", "b")] * 2
