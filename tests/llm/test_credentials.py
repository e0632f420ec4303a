import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import credential_training as t
from tidewatch.llm import credentials as c


def texts(s):
    return [s[a:b] for a, b in c.find(s)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('password = "Tr0ub4dor!x9"', ["Tr0ub4dor!x9"]),
        ("→   12 | api_key: 'a81c6d0f53b94c17e2d8a7b65f0c4e39'", ["a81c6d0f53b94c17e2d8a7b65f0c4e39"]),
        ("conn = 'postgres://app:pW9x!kk2z@db.example:5432/x'", ["pW9x!kk2z"]),
        ("curl -u app:zz9Qk!LmP2 https://h.example/x", ["zz9Qk!LmP2"]),
        ("Cookie: sid=0123456789abcdef0123456789abcdef", ["0123456789abcdef0123456789abcdef"]),
        ("kind: Secret\ndata:\n  password: Y29ycmVjdEhvcnNlOTc=", ["Y29ycmVjdEhvcnNlOTc="]),
        ("token = 'AbCdEf123456gH' + \\\n    'IjKlMn789012oP'", ["AbCdEf123456gH", "IjKlMn789012oP"]),
        ("const q = '" + "ab12" * 16 + "';\nconst mac = crypto.createHmac('sha256', q);", ["ab12" * 16]),
        ("const q = '" + "ab12" * 16 + "';\nsend(q);", []),
        ("password = os.environ['DB_PASSWORD']", []),
        ("api_key = '<your-api-key>'", []),
        ("sha256 = '" + "0f" * 32 + "'", []),
        ("password_min_length = 12", []),
        ("Authorization: Bearer $TOKEN", []),
        ("secretName: app-credentials", []),
        ("-----BEGIN PUBLIC KEY-----\nabc\n-----END PUBLIC KEY-----", []),
        ("", []),
    ],
)
def test_cases(text, want):
    assert texts(text) == want


def test_private_key_span():
    key = "-----BEGIN RSA PRIVATE KEY-----\nAbc123/+\nZz==\n-----END RSA PRIVATE KEY-----"
    assert texts(f'x = 1\nk = """{key}"""\ny = 2') == [key]


def test_held_out_accuracy():
    held, missed = t.sequences(4242, 6)
    precision, recall = t.score(c.model(), held)
    assert precision > 0.98 and recall > 0.98 and missed <= 3


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_spans_are_in_order_and_redaction_keeps_the_rest(s):
    spans = c.find(s)
    assert all(0 <= a < b <= len(s) for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    rest = c.redact(s)
    for part in [s[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[a for a, _ in spans], len(s)])]:
        assert part in rest


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120))
def test_tokens_lie_in_the_line(s):
    line = s.replace("\n", " ")
    for tok in c.lex(line):
        assert line[tok.start : tok.end] == tok.text


def test_spark_spans(spark):
    rows = [(1, 'password = "Tr0ub4dor!x9"', None, "k"), (1, 'password = "Tr0ub4dor!x9"', None, "k"), (2, None, "😀 X-Api-Key: ghp_0123456789abcdefABCDEF0123456789abcd", "k"), (None, 'password = "Tr0ub4dor!x9"', "", "k"), (3, "", "nothing", "k"), (4, "x" * 300_000 + "\npassword = 'Tr0ub4dor!x9'", None, "k")]
    df = spark.createDataFrame(rows, "db_id long, code_snippet string, exploit_poc string, text string")
    got = sorted(tuple(r) for r in c.spans(df).collect())
    assert got == [(1, "code_snippet", 12, 24), (2, "exploit_poc", 13, 53), (4, "code_snippet", 300_013, 300_025)]
    red = {(r.db_id, r.field_name): r.redacted_text for r in c.redacted(df).collect()}
    assert red[1, "code_snippet"] == f'password = "{c.REDACTED}"'
    assert c.spans(df.limit(0)).count() == 0


def straight(text):
    """Spans from the model itself, without kept paths."""
    spans = list(c.lines(text))
    out = []
    for (a, b), mark in zip(spans, c.contexts(text, spans)):
        tokens = c.lex(text[a:b])
        labels = c.model().viterbi(c.features(tokens, mark)) if tokens else []
        out += [(a + t.start, a + t.end) for t, y in zip(tokens, labels) if y == 3]
    return out


PIECES = ["db_pw", "DB_PW", "api", "key", "login(", "conn(", '"root"', '"Tr0ub4dor&3"', "'x9Q!kk2z'", "=", ":", "==", ",", ")", "user", "-p", "-u", "https://a:b9X!k@h/", "value", '"password"', "token", "Bearer", "a1b2c3d4e5f6a7b8", ".", "[", "]", "{", "getenv(", "is", "with", "default", "psw", "x.password"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12), st.sampled_from(["", " "]))
def test_kept_paths_are_those_of_the_model(pieces, sep):
    line = sep.join(pieces)
    assert c.find(line) == straight(line)


def test_generated_code_has_the_models_path():
    m = t.Maker(77)
    for code in t.positives(m) + t.negatives(m):
        code = code.translate({1: None, 2: None})  # marks of the labels
        assert c.find(code) == straight(code)


@pytest.mark.parametrize("line", ['db_pw = "{}"', 'dbPw: "{}"', 'psw = "{}"', 'contraseña = "{}"', 'parole: "{}"', 'user_sid = "{}"', 'conn("db", "root", "{}")'])
def test_no_line_is_left_out(line):
    assert texts(line.format("Tr0ub4dor&3")) == ["Tr0ub4dor&3"]


def test_long_names_are_read_whole():
    name = "a_" * 400 + "password"
    assert c.name_class(name) == "secret"
    assert texts(f'{name} = "Tr0ub4dor&3"') == ["Tr0ub4dor&3"]


def test_redaction_leaves_code_whole():
    assert c.redact("password: Tr0ub4dor&3x") == "password: REDACTED"
    assert c.redact("db = 'postgres://app:pW9x!kk2z@db:5432/x'") == "db = 'postgres://app:REDACTED@db:5432/x'"
    s = "pin = 83920174"
    assert c.redact(s, [(6, 14)]) == "pin = 0"
    assert c.redact(s.replace("8", "'8").replace("4", "4'"), [(7, 15)]) == "pin = 'REDACTED'"


def test_names_with_secret_parts(spark):
    rows = [(i, f'{name} = "Tr0ub4dor&3"', None) for i, name in enumerate(["db_pw", "DB_PW", "dbPw", "adminPw", "psw", "contraseña", "CONTRASEÑA", "parole"])]
    got = {r.db_id for r in c.spans(spark.createDataFrame(rows, "db_id long, code_snippet string, exploit_poc string")).collect()}
    assert got == {r[0] for r in rows}
