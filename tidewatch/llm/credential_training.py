"""Train the credential CRF on generated code: python -m tidewatch.llm.credential_training

Lines of code, configuration, commands and HTTP are generated from templates with credentials
(marked), placeholders, references, checksums and settings, so every label is exact. Nothing is
taken from the data. The trained weights are written to credential_crf.json; a held-out part
drawn with another seed gives the accuracy printed at the end.
"""

from __future__ import annotations

import base64
import json
import random
import string

import numpy as np

from tidewatch.llm import credentials as c

# Parts of the generated lines.
WORDS = "anchor beacon cedar delta ember falcon garnet harbor island jasper kernel lantern meadow nickel orchid pepper quarry river saddle timber umbra vector willow yonder zephyr market ledger parcel camera garden engine window".split()
PASS_NAMES = "password passwd pwd pass passphrase secret db_password dbPassword DB_PASS admin_pwd userPassword smtp_password root_pass client_secret clientSecret app_secret appSecret PASSWORD SECRET master_password loginPassword Passwort motDePasse".split()
KEY_NAMES = "api_key apiKey API_KEY token access_token accessToken auth_token authToken secret_key SECRET_KEY signing_key signingKey encryption_key service_key private_token jwt refresh_token client_secret license_key storage_key bearer_token AccessKey X_API_KEY session_token".split()
USER_NAMES = "user username login uid account".split()
HASH_NAMES = "sha256 sha1 md5 checksum etag commit digest revision request_id trace_id fingerprint integrity build_hash content_md5 git_sha correlation_id asset_hash".split()
SETTINGS = "password_min_length max_password_age token_ttl_seconds secret_rotation_days password_policy passwordLength token_limit session_timeout key_size auth_enabled password_field secret_name token_type api_key_header credentials_file password_hint tokenExpiry".split()
PLACEHOLDERS = ["YOUR_API_KEY", "your-token-here", "<password>", "changeme", "[REDACTED]", "****", "xxxxxxxx", "<your key>", "INSERT_TOKEN_HERE", "example-secret", "placeholder", "TODO", "none", "", "******", "dummy", "Enter your password", "<insert token>", "REPLACE_ME_your_key", "••••••"]
REFS = ["${DB_PASSWORD}", "$TOKEN", "$(SECRET)", "{{ vault_key }}", "%(token)s", "$SECRET_KEY", "${env.API_KEY}", "{{api_token}}"]
CODE_REFS = ['os.environ["{N}"]', "os.getenv('{N}')", "process.env.{N}", "config.{n}", "settings.{n}", "vault.read('{w}/{n}')", "get_secret('{w}')", "request.form['{n}']", 'req.getParameter("{n}")', "params[:{n}]", "r.FormValue(\"{n}\")", "user.{n}", "load_{n}()", "$_POST['{n}']", "ctx.query.{n}", "{n}"]


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def chars(self, alphabet: str, n: int) -> str:
        return "".join(self.r.choice(alphabet) for _ in range(n))

    def word(self) -> str:
        return self.r.choice(WORDS)

    def password(self, url: bool = False) -> str:
        r = self.r
        an = string.ascii_letters + string.digits
        k = r.randrange(9)
        if k == 7:
            return self.chars(string.ascii_letters, r.randint(9, 18))
        if k == 8:
            return f"{self.word()}_{self.word()}_{r.randrange(1, 999)}"
        if k == 0:
            return self.chars(an, r.randint(9, 18)) + r.choice(string.digits)
        if k == 1:
            s = self.chars(an + ("!._-" if url else "!._-%#&+*?$~^"), r.randint(8, 15))
            return r.choice(an) + s + str(r.randrange(10, 99))
        if k == 2:
            return self.word().capitalize() + str(r.randrange(10, 2000)) + r.choice("!*?#")
        if k == 3:
            return "".join(w.capitalize() if i else w for i, w in enumerate((self.word(), self.word(), self.word()))) + str(r.randrange(1, 99))
        if k == 4:
            return r.choice("._-").join((self.word(), self.word())) + r.choice("._-") + str(r.randrange(1, 999))
        if k == 5:
            w = self.word()
            return "".join({"a": "4", "e": "3", "o": "0", "i": "1"}.get(ch, ch) if r.random() < 0.6 else ch for ch in w).capitalize() + r.choice("!%&#") + self.chars(an, 3)
        return self.chars(an, r.randint(10, 20))

    def key(self) -> str:
        r = self.r
        an = string.ascii_letters + string.digits
        k = r.randrange(10)
        if k == 0:
            return self.chars("0123456789abcdef", r.choice((32, 40, 48, 64)))
        if k == 1:
            return "AKIA" + self.chars(string.ascii_uppercase + "234567", 16)
        if k == 2:
            return r.choice(("ghp_", "gho_")) + self.chars(an, 36)
        if k == 3:
            return "glpat-" + self.chars(an + "_-", 20)
        if k == 4:
            return r.choice(("sk_live_", "rk_live_")) + self.chars(an, 24)
        if k == 5:
            return f"xoxb-{self.chars(string.digits, 12)}-{self.chars(string.digits, 12)}-{self.chars(an, 24)}"
        if k == 6:
            return f"{self.chars(string.ascii_lowercase, r.randint(3, 6))}_{r.choice(('pat', 'key', 'tok'))}_{self.chars(an, 38)}A1"
        if k == 7:
            return f"{self.chars(string.ascii_lowercase, 3)}-{self.chars('0123456789abcdef', 8)}-{self.chars(an, 28)}B7"
        if k == 8:
            return base64.b64encode(self.r.randbytes(24)).decode()
        return self.chars(an + r.choice(("", "_-", "/+")), r.choice((24, 32, 40)))

    def jwt(self) -> str:
        def part(n: int) -> str:
            return base64.urlsafe_b64encode(self.r.randbytes(n)).decode().rstrip("=")

        return "eyJ" + part(24) + ".eyJ" + part(36) + "." + part(32)

    def token(self) -> str:
        return self.jwt() if self.r.random() < 0.3 else self.key()

    def hash(self) -> str:
        r = self.r
        if r.random() < 0.2:
            h = self.chars("0123456789abcdef", 32)
            return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))
        return self.chars("0123456789abcdef", r.choice((32, 40, 64)))

    def b64(self, s: str) -> str:
        return base64.b64encode(s.encode()).decode()

    def secret(self) -> str:
        return self.password() if self.r.random() < 0.5 else self.token()

    def host(self) -> str:
        return f"{self.word()}-{self.word()}.{self.r.choice(('example', 'test', 'internal.example', 'net'))}"

    def ident(self) -> str:
        return "_".join(self.r.sample(WORDS, self.r.randint(1, 2)))

    def body(self, kind: str, sep: str) -> str:
        rows = sep.join(self.chars(string.ascii_letters + string.digits + "+/", 64) for _ in range(self.r.randint(2, 5)))
        head = self.r.choice(("RSA ", "EC ", "OPENSSH ", "")) if kind == "PRIVATE KEY" else ""
        return f"-----BEGIN {head}{kind}-----{sep}{rows}=={sep}-----END {head}{kind}-----"


def positives(m: Maker) -> list[str]:
    """Lines with the credential between \\x01 and \\x02."""
    r = m.r
    q = r.choice("'\"")
    n, k = r.choice(PASS_NAMES), r.choice(KEY_NAMES)
    w, i, h = m.word(), m.ident(), m.host()

    def S(v: str) -> str:
        return f"\x01{v}\x02"

    p, t = S(m.password()), S(m.token())
    op = r.choice((" = ", "=", ": ", " := ", " => "))
    return [
        f"{n}{op}{q}{p}{q}",
        f"{k}{op}{q}{t}{q}",
        f"{r.choice(('const', 'let', 'var', 'String', 'private static final String'))} {k} = {q}{t}{q};",
        f"self.{n} = {q}{p}{q}",
        f"{q}{k}{q}: {q}{t}{q},",
        f"{q}{n}{q} => {q}{p}{q},",
        f"  {r.choice(PASS_NAMES[:6])}: {p}",
        f"{i.upper()}_{r.choice(('PASSWORD', 'SECRET', 'TOKEN', 'API_KEY'))}={S(m.secret())}",
        f"{r.choice(('', 'export ', 'ENV '))}{i.upper()}_KEY={S(m.token())}",
        f"{r.choice(('', 'export ', 'ENV '))}{i.upper()}_KEY={S(m.chars('0123456789abcdef', r.choice((32, 40, 64))))}",
        f"export {i.upper()}_{r.choice(('PASSWORD', 'SECRET', 'TOKEN', 'API_KEY'))}={S(m.secret())}",
        f"ENV {i.upper()}_{r.choice(('PASSWORD', 'SECRET', 'TOKEN'))}={S(m.secret())}",
        f"{r.choice(('opts', 'cfg', 'settings', 'conf'))}[{q}{n}{q}] = {q}{p}{q}",
        f"conn = {q}{r.choice(('postgresql', 'mysql', 'amqp', 'redis', 'mongodb', 'ftp', 'https'))}://{w}:{S(m.password(True))}@{h}:{r.randrange(1000, 9000)}/{m.word()}{q}",
        f"url: {r.choice(('postgres', 'https'))}://{w}:{S(m.password(True))}@{h}/",
        f"fetch({q}https://{h}/v1/{w}?limit={r.randrange(99)}&{r.choice(('access_token', 'api_key', 'token', 'key_token'))}={S(m.key().replace('+', 'a').replace('/', 'b').replace('=', ''))}&page=2{q})",
        f"{r.choice(('jdbc.url=', ''))}jdbc:sqlserver://{h};user={w};password={S(m.chars(string.ascii_letters + string.digits, 12) + '4')};encrypt=true",
        f"{q}Server={h};Uid={w};Pwd={S(m.chars(string.ascii_letters + string.digits, 12) + '4')};{q}",
        f"AccountName={w}store;AccountKey={S(base64.b64encode(r.randbytes(64)).decode())};EndpointSuffix={h}",
        f"headers = {{{q}Authorization{q}: {q}Bearer {t}{q}}}",
        f"req.setHeader({q}Authorization{q}, {q}Bearer {t}{q})",
        f"req.setHeader({q}Authorization{q}, {q}Basic {S(m.b64(w + ':' + m.password()))}{q})",
        f"Authorization: Basic {S(m.b64(w + ':' + m.password()))}",
        f"Authorization: Bearer {t}",
        f"curl -H {q}Authorization: Bearer {t}{q} https://{h}/{w}",
        f"curl -s -H {q}X-Api-Key: {t}{q} {q}https://{h}/{w}?q=1{q}",
        f"curl -u {w}:{S(m.password(True))} https://{h}/{w}/{r.randrange(99)}",
        f"curl --user {w}:{S(m.password(True))} https://{h}/{w}",
        f"mysql -h {h} -u {w} -p{q}{p}{q} -e 'show tables'",
        f"mysql -h {h} -u {w} -p{S(m.chars(string.ascii_letters + string.digits, 11) + '7')} {w}",
        f"psql \"host={h} user={w} password={S(m.password(True))}\" -c \"select 1\"",
        f"X-Api-Key: {t}",
        f"X-Auth-Token: {t}",
        f"Cookie: {r.choice(('sid', 'session', 'sessionid', 'session_id', 'auth_token'))}={S(m.chars('0123456789abcdef', r.choice((32, 40))))}",
        f"requests.post({q}https://{h}/{w}{q}, auth=({q}{w}{q}, {q}{p}{q}), data={{'id': '1'}})",
        f"client.login({q}{w}{q}, {q}{p}{q})",
        f"{w}.{r.choice(('authenticate', 'connect', 'signIn'))}({q}{m.word()}{q}, {q}{p}{q});",
        f"storage.configure({q}{w}{q}, {q}{S(m.key())}{q})",
        f"{r.choice(('aes', 'cipher', 'box'))} = AES.new(bytes.fromhex({q}{S(m.chars('0123456789abcdef', r.choice((32, 64))))}{q}), MODE_GCM)",
        f"Fernet({q}{S(base64.urlsafe_b64encode(r.randbytes(32)).decode())}{q})",
        f"mac = hmac.new({q}{S(m.secret())}{q}, body)",
        f"<add key={q}{r.choice(('SmtpPassword', 'ServiceKey', 'ApiSecret', 'DbPassword', 'AuthToken'))}{q} value={q}{S(m.secret())}{q} />",
        f"<{r.choice(('password', 'apiKey', 'secret'))}>{S(m.chars(string.ascii_letters + string.digits, 12) + '5')}</password>",
        f"CREATE USER {w} IDENTIFIED BY '{p}';",
        f"ALTER USER {w} WITH PASSWORD '{p}';",
        f"machine {h} login {w} password {S(m.password(True))}",
        f"//{h}/:_authToken={S(m.key().replace('=', ''))}",
        f"{r.choice(('# old login', '// temporary', '// test key', '# vorläufig', '// à supprimer'))}{r.choice((', remove later', ', Schlüssel', ''))}: {r.choice(('pw', 'password', 'pass'))} {S(m.password(True))}",
        f"{r.choice(('Passwort', 'Password', 'Kennwort', 'pw'))}: {S(m.password(True))}  # {r.choice(('Zugang für', 'login of', 'for'))} {w}",
        f"2. Sign in as {w} with password {S(m.password(True))}",
        f"Log in as {w} using the password {S(m.password(True))}",
        f"if ({r.choice(('pass', 'password', 'pin', 'pwd'))} == {q}{p}{q}) {{ allow(); }}",
        f"{k} = {q}{S(m.body('PRIVATE KEY', chr(10)))}{q}",
        f"{r.choice(('key_pem', 'tls_key', 'SIGNING_KEY', 'ssh_key'))} = {q * 3}{S(m.body('PRIVATE KEY', chr(10)))}{q * 3}",
        f"\"private_key\": \"{S(m.body('PRIVATE KEY', chr(92) + 'n'))}\",",
        S(m.body("PRIVATE KEY", "\n")),
        f"{k} = {q}{S(m.chars(string.ascii_letters + string.digits, 15))}{q} + \\\n        {q}{S(m.chars(string.ascii_letters + string.digits, 14))}{q}",
        f"const {w[0]} = '{S(m.chars('0123456789abcdef', 64))}';\nconst mac = crypto.createHmac('sha256', {w[0]});",
        f"kind: Secret\ndata:\n  {r.choice(('password', 'token', 'key', 'value', 'api'))}: {S(m.b64(m.password()))}",
        f"kind: Secret\nstringData:\n  {r.choice(('password', 'token', 'key'))}: {S(m.password(True))}",
        f"datasource:\n  username: {w}_app\n  password: {p}",
        f"{r.choice(('--password', '--token', '--api-key'))} {S(m.password(True))}",
        f"{r.choice(('--password', '--token', '--api-key'))}={S(m.password(True))}",
    ]


def negatives(m: Maker) -> list[str]:
    r = m.r
    q = r.choice("'\"")
    n, k = r.choice(PASS_NAMES), r.choice(KEY_NAMES)
    w, i, h = m.word(), m.ident(), m.host()
    op = r.choice((" = ", "=", ": ", " := "))
    ph, ref, ha = r.choice(PLACEHOLDERS), r.choice(REFS), m.hash()
    code = r.choice(CODE_REFS).format(N=k.upper(), n=r.choice((n, k)), w=w)
    one = r.randrange(1, 4000)
    return [
        f"{n}{op}{q}{ph}{q}",
        f"{k}{op}{q}{ph}{q}",
        f"{n}{op}{q}{ref}{q}",
        f"{k}: {ref}",
        f"{n}={ref}",
        f"{n} = {code}",
        f"const {k} = {code};",
        f"{k} := {code}",
        f"cfg.{n} = {n}",
        f"login({w}, {n}={n})",
        f"set_{k}({k})",
        f"if {n} == expected_{n}:",
        f"{r.choice(HASH_NAMES)}{op}{q}{ha}{q}",
        f"{r.choice(HASH_NAMES)}: {ha}",
        f"{w}-{m.word()} integrity sha512-{base64.b64encode(r.randbytes(64)).decode()}",
        f"{r.choice(SETTINGS)}{op}{one}",
        f"{r.choice(SETTINGS).upper()}={one}",
        f"{r.choice(SETTINGS)}: {q}at least {w} characters{q}",
        f"label_{n} = {q}{r.choice(('Password', 'Secret', 'Token', 'Your password', 'Passwort'))}{q}",
        f"{q}{n}{q}: {q}{r.choice(('Enter your password', 'Password', 'Forgot it?', 'Please type it again'))}{q},",
        f"tokens = tokenizer.split({q}{w} {m.word()}{q})",
        f"key = {q}{w}.{m.word()}.{m.word()}{q}",
        f"sort_key = {q}{w}{q}",
        f"{r.choice(('primary_key', 'foreign_key', 'cache_key', 'partition_key'))}: {i}",
        f"secretName: {w}-{m.word()}-credentials",
        f"credentials_path{op}{q}/etc/{w}/{m.word()}.json{q}",
        f"img = {q}data:image/png;base64,{base64.b64encode(r.randbytes(48)).decode()}{q}",
        m.body("PUBLIC KEY", "\n"),
        m.body("CERTIFICATE", "\n"),
        f"conn = {q}postgresql://{w}@{h}/{m.word()}{q}",
        f"url = {q}https://${{USER}}:${{PASS}}@{h}/{q}",
        f"url = {q}https://{w}:<password>@{h}/{q}",
        f"url = {q}https://{h}/{w}?page={one}{q}",
        f"Authorization: Bearer {r.choice(('$TOKEN', '<token>', '{{token}}', '${TOKEN}'))}",
        f"curl -H {q}Authorization: Bearer {r.choice(('$TOKEN', '<token>', '${TOKEN}'))}{q} https://{h}/{w}/{one}",
        f"curl -u {w}:{r.choice(('<password>', '$PASS', '${PASSWORD}', '****'))} https://{h}/{w}  # trace {m.chars('0123456789abcdef', 32)}",
        f"curl 'https://{h}/{w}?{n}=1%20or%201=1'",
        f"X-Api-Key: {r.choice(('<your key>', '$KEY', '{{key}}'))}",
        f"Cookie: theme=dark; lang={w}",
        f"POST /{w} with body {{{q}{r.choice(('user_id', 'token_id', 'id', 'ref'))}{q}: {q}{m.chars('0123456789abcdef', 24)}{q}}} twice; the second answer holds the other record.",
        f"{w} = request.args.get({q}{r.choice(('token_id', 'user_id', 'name', 'password'))}{q})",
        f"throw new Error({q}{r.choice(('token_id', 'password', 'secret', 'api_key'))} missing{q});",
        f"raise ValueError({q}{r.choice(('token', 'password', 'login'))} is too {w}{q})",
        f"logger.info({q}{i} %d{q}, {one})",
        f"LOG.info({q}{i} {q} + {one});",
        f"console.log({q}{i}{q}, {one});",
        f"out.append(item[{q}{r.choice(('token_id', 'name', 'key'))}{q}])",
        f"return {i}({w}, {one})",
        f"function {i}({w}) {{",
        f"const rows = await db.all({w});",
        f"rows = db.fetch({w}, limit={one})",
        f"{w}, err := db.Fetch(ctx, {m.word()})",
        f"def {i}({w}, limit={one}):",
        f"client.login({w}, {n})",
        f"client.login({q}{w}{q}, {r.choice(WORDS)}{m.word().capitalize()})",
        f"{r.choice(('name', 'title', 'column'))} = {q}{w}_{m.word()}_{r.randrange(99)}{q}",
        f"{r.choice(('name', 'field', 'event'))} = {q}{w}{m.word().capitalize()}{q}",
        f"client.login({q}{w}{q}, {code})",
        f"storage.configure({q}{w}{q}, {code})",
        f"mac = crypto.createHmac('sha256', {w})",
        f"req.setHeader({q}Authorization{q}, {q}Bearer {q} + token)",
        f"req.setHeader({q}Content-Type{q}, {q}application/json{q})",
        f"<add key={q}{r.choice(('Theme', 'PageSize', 'ServiceUrl', 'PasswordMinLength'))}{q} value={q}{r.choice((w, str(one), 'https://' + h))}{q} />",
        f"<add key={q}{r.choice(('SmtpPassword', 'ServiceKey'))}{q} value={q}{ref}{q} />",
        f"CREATE USER {w} IDENTIFIED BY '{ph or '***'}';",
        f"username: {w}_app",
        f"user={w}",
        f"kind: ConfigMap\ndata:\n  {r.choice(('mode', 'theme', 'level'))}: {w}",
        f"kind: {r.choice(('Service', 'Deployment', 'Pod'))}",
        f"const {w[0]} = '{m.chars('0123456789abcdef', 64)}';",
        f"const {r.choice(HASH_NAMES)} = '{m.chars('0123456789abcdef', 64)}';\nverify({w});",
        f"version = {q}{r.randrange(9)}.{r.randrange(9)}.{r.randrange(9)}{q}",
        f"Sign in as {w} and open /{w}/{one}",
        f"Send {r.choice(('token_id', 'user_id', 'key_name', 'file', 'lang'))}=../../{w}.cfg to /{w} and read the answer.",
        f"Send {r.choice(('token_id', 'name', 'session_name'))}={w}.{r.choice(('cfg', 'txt', 'json'))} to /{w}",
        f"{r.choice(('token_id', 'secret_id', 'key_id', 'credential_id'))}={r.choice((str(one), m.chars('0123456789abcdef', 24), w))}",
        f"1. Open the login page",
        f"The password of {w} is checked by {i}.",
        f"Reset the token for {w} before the session ends.",
        f"GET /{w}?{r.choice(('token_id', 'key', 'id'))}=%3Csvg%3E HTTP/1.1",
        f"Host: {h}",
        f"--password-file {w}",
        f"docker run -p {one}:80 -u {w} {m.word()}:latest",
        f"{k} = {q}{'x' * r.randrange(6, 30)}{q}",
        f"{r.choice(('public_key', 'publicKey', 'site_key_public'))} = {q}{m.key()}{q}",
    ]


def sequences(seed: int, rounds: int) -> tuple[list[tuple[list[list[str]], list[int]]], int]:
    """(features, labels) of every generated line; number of credentials that are no token (lexer misses)."""
    m = Maker(seed)
    out, missed = [], 0
    for _ in range(rounds):
        for text in positives(m) + negatives(m):
            if m.r.random() < 0.3:
                lines = text.split("\n") if "-----" not in text else [text]
                text = "\n".join(f"{'→' if x == 0 else ' '}   {40 + x} | {line}" for x, line in enumerate(lines)) if len(lines) > 1 or "-----" not in text else text
            clean, spans, at = "", [], 0
            for ch in text:
                if ch == "\x01":
                    at = len(clean)
                elif ch == "\x02":
                    spans.append((at, len(clean)))
                else:
                    clean += ch
            rows = list(c.lines(clean))
            for (a, b), mark in zip(rows, c.contexts(clean, rows)):
                tokens = c.lex(clean[a:b])
                if not tokens:
                    continue
                want = {s for s in spans if a <= s[0] < b}
                y = [3 if (a + t.start, a + t.end) in want else 0 for t in tokens]
                missed += len(want) - y.count(3)
                for i, lab in enumerate(list(y)):
                    if lab == 3:
                        k = c.governor(tokens, i)[2]
                        if k >= 0:
                            y[k] = 1 if y[k] == 0 else y[k]
                            for j in range(k + 1, i):
                                y[j] = 2 if y[j] == 0 and tokens[j].kind in ("op", "quote", "punct") else y[j]
                out.append((c.features(tokens, mark), y))
    return out, missed


def train(data: list, epochs: int = 8, rate: float = 0.25, l2: float = 1e-5, seed: int = 1) -> c.Crf:
    """AdaGrad on the conditional log-likelihood (forward-backward a sequence)."""
    names = sorted({f for x, _ in data for row in x for f in row})
    at = {f: i for i, f in enumerate(names)}
    k = len(c.LABELS)
    w, tr = np.zeros((len(names), k)), np.zeros((k, k))
    gw, gt = np.full_like(w, 1e-2), np.full_like(tr, 1e-2)
    seqs = [([np.array([at[f] for f in row]) for row in x], np.array(y)) for x, y in data]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for s in rng.permutation(len(seqs)):
            x, y = seqs[s]
            n = len(y)
            e = np.array([w[row].sum(0) for row in x])
            a, b = np.zeros((n, k)), np.zeros((n, k))
            a[0] = e[0]
            for i in range(1, n):
                z = a[i - 1][:, None] + tr
                mx = z.max(0)
                a[i] = mx + np.log(np.exp(z - mx).sum(0)) + e[i]
            for i in range(n - 2, -1, -1):
                z = tr + (e[i + 1] + b[i + 1])[None, :]
                mx = z.max(1)
                b[i] = mx + np.log(np.exp(z - mx[:, None]).sum(1))
            logz = a[-1].max() + np.log(np.exp(a[-1] - a[-1].max()).sum())
            p = np.exp(a + b - logz)
            p[np.arange(n), y] -= 1
            if n > 1:
                g = np.exp(a[:-1, :, None] + tr[None] + (e[1:] + b[1:])[:, None, :] - logz).sum(0)
                np.subtract.at(g, (y[:-1], y[1:]), 1)
                gt += g * g
                tr -= rate * g / np.sqrt(gt)
            for row, d in zip(x, p):
                if np.abs(d).max() < 1e-4:
                    continue
                gr = d + l2 * w[row]
                gw[row] += gr * gr
                w[row] -= rate * gr / np.sqrt(gw[row])
    return c.Crf({f: [round(float(v), 3) for v in w[i]] for f, i in at.items() if np.abs(w[i]).max() > 0.02}, [[round(float(v), 3) for v in r] for r in tr])


def score(crf: c.Crf, data: list) -> tuple[float, float]:
    """(precision, recall) of S tokens."""
    hit = said = true = 0
    for x, y in data:
        p = crf.viterbi(x)
        said += p.count(3)
        true += y.count(3)
        hit += sum(a == b == 3 for a, b in zip(p, y))
    return hit / max(said, 1), hit / max(true, 1)


if __name__ == "__main__":
    data, missed = sequences(11, 90)
    print("sequences", len(data), "credentials that are no token", missed)
    crf = train(data)
    c.MODEL.write_text(json.dumps({"labels": c.LABELS, "weights": dict(sorted(crf.weights.items())), "transitions": crf.transitions}, indent=0))
    held, missed = sequences(99, 10)
    for x, y in held:
        p = crf.viterbi(x)
        if any((a == 3) != (b == 3) for a, b in zip(p, y)):
            i = next(i for i, (a, b) in enumerate(zip(p, y)) if (a == 3) != (b == 3))
            print("  missed" if y[i] == 3 else "  wrong", [f for f in x[i] if "|" in f][:4])
    print("held out: precision %.4f, recall %.4f" % score(crf, held), "features", len(crf.weights))
