"""Credentials embedded in source code: found exactly and redacted.

Lexical tokens of each line are labelled by a linear-chain conditional random field over shape
and context features; the Viterbi path's S tokens are the literal characters to redact. Labels:
S a credential's literal value, N the name or scheme word that announces it, L what links them,
O the rest. The weights come from ``credential_training`` (credential_crf.json beside this
file): trained on generated, exactly labelled code, none of it from the data.

At scale: texts repeat over scans, so each distinct text is labelled once. Every line of it goes
through the model; nothing is left out beforehand. What makes that cheap is that the features
see of a token only its kind, shape, name class and few more marks: lines that agree in these
(``skeleton``) have the same Viterbi path, which each worker keeps.
"""

from __future__ import annotations

import json
import pkgutil
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("O", "N", "L", "S")
MODEL = Path(__file__).with_name("credential_crf.json")
FIELDS = ("code_snippet", "exploit_poc")
#: Stands for a value: a plain word in code, YAML, shell and URLs, valid base64 in a secret manifest.
REDACTED = "REDACTED"
#: Stands for a bare number, where a word would not be a literal.
REDACTED_NUMBER = "0"

# --- lexer ------------------------------------------------------------------------------------

_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*?)(PRIVATE KEY(?: BLOCK)?|PUBLIC KEY(?: BLOCK)?|CERTIFICATE(?: REQUEST)?)-----[\s\S]*?-----END \1\2-----")
_GUTTER = re.compile(r"[→>*]?[ \t]*\d+ ?\| ?")
_STRING = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\\n]|\\.)*`")
_URL = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)+//|//(?=[\w.-]+/:)")
_USERINFO = re.compile(r"([^\s/@'\"`:]*)(?::([^\s'\"`/]*))?@(?=[\w$\[{-])")
_QUERY = re.compile(r"([?&;])([\w.\[\]-]+)=([^\s&'\"`#;<>]*)")
_PAIR = re.compile(r"(?<!\S)--?[A-Za-z][\w-]*(?=[\s=]|$)|[^\s'\"`,;(){}<>\[\]:=]+(?:={1,2}(?![\w'\"`$=]))?|:=|=>|===?|!==?|[=:]|[^\w\s]")
_SHORT_FLAG = re.compile(r"-([pPuU])(?=\S)")
_LONG_FLAG = re.compile(r"-[pPuU][a-z]{3,}")
_FLAG = re.compile(r"--?[A-Za-z][\w-]*")
_SINGLE = frozenset(",;(){}<>[]")
_OPS = frozenset((":=", "=>", "=", ":", "==", "===", "!=", "!=="))
#: Inside quotes: content with blanks, a URL, pairs or a scheme word is lexed further, any other is one token.
_STRUCTURED = re.compile(r"\s|://|[?;&]\w+=|^[A-Za-z_][\w.-]*[=:](?=[^=\s])|^[^:]+:[^:]*@")


class Token:
    __slots__ = ("end", "kind", "start", "text")

    def __init__(self, text: str, start: int, kind: str) -> None:
        self.text, self.start, self.end, self.kind = text, start, start + len(text), kind


def _bare(text: str, at: int, base: int, end: int, out: list[Token]) -> None:
    """Lex text[at:end] outside of quotes; ``base`` is added to offsets."""
    urls = text.find("//", at, end) >= 0
    while at < end:
        ch = text[at]
        if ch.isspace():
            at += 1
            continue
        if ch in _SINGLE:
            out.append(Token(ch, base + at, "punct"))
            at += 1
            continue
        if ch in "'\"`" and (m := _STRING.match(text, at, end)):
            _quoted(text, at, m.end(), base, out)
            at = m.end()
            continue
        if urls and (m := _URL.match(text, at, end)):
            at = _url(text, at, m.end(), base, end, out)
            continue
        if ch == "-" and (m := _SHORT_FLAG.match(text, at, end)) and (at == 0 or text[at - 1].isspace()) and not (out and (out[-1].kind == "op" or name_class(out[-1].text) == "secret")) and not _LONG_FLAG.match(text, at, end):
            out.append(Token(m[0], base + at, "flag"))
            at = m.end()
            continue
        m = _PAIR.match(text, at, end)
        if m is None:
            at += 1
            continue
        t = m[0]
        if len(t) > 1 and t[0] not in ":=!" and t[-1] in ".,":
            t = t.rstrip(".,") or t
        kind = "word" if t[0].isalnum() or len(t) > 3 or t[0] in "_$" and len(t) > 1 else "op" if t in _OPS else "punct"
        if ch == "-" and _FLAG.fullmatch(t):
            kind = "flag" if len(t) < 24 and not any(c.isdigit() for c in t) else "word"
        out.append(Token(t, base + at, kind))
        at += len(t)


def _url(text: str, at: int, after: int, base: int, end: int, out: list[Token]) -> int:
    out.append(Token(text[at:after], base + at, "scheme"))
    at = after
    if m := _USERINFO.match(text, at, end):
        # The last @ before the path ends the user part.
        user, pw = m[1], m[2]
        if user:
            out.append(Token(user, base + at, "user"))
        if pw is not None:
            out.append(Token(":", base + m.start(2) - 1, "op"))
            if pw:
                out.append(Token(pw, base + m.start(2), "urlpass"))
        at = m.end()
    stop = at
    while stop < end and not text[stop].isspace() and text[stop] not in "'\"`<>?;,)":
        if text[stop] == ":" and text.startswith(":_", stop):
            break
        stop += 1
    if stop > at:
        out.append(Token(text[at:stop], base + at, "host"))
    at = stop
    if at < end and text[at] in "?;":
        while m := _QUERY.match(text, at, end):
            out.append(Token(m[1], base + m.start(1), "punct"))
            out.append(Token(m[2], base + m.start(2), "word"))
            out.append(Token("=", base + m.end(2), "op"))
            if m[3]:
                out.append(Token(m[3], base + m.start(3), "word"))
            at = m.end()
    return at


def _quoted(text: str, at: int, end: int, base: int, out: list[Token]) -> None:
    out.append(Token(text[at], base + at, "quote"))
    inner = text[at + 1 : end - 1]
    if inner:
        if _STRUCTURED.search(inner):
            _bare(text, at + 1, base, end - 1, out)
        else:
            out.append(Token(inner, base + at + 1, "string"))
    out.append(Token(text[end - 1], base + end - 1, "quote"))


def lines(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each line; a PEM block and what stands on its lines is one line."""
    blocks = [m.span() for m in _PEM.finditer(text)] if "-----BEGIN" in text else []
    at, k = 0, 0
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        while k < len(blocks) and blocks[k][0] < end:
            if blocks[k][1] > end:
                end = text.find("\n", blocks[k][1])
                end = len(text) if end < 0 else end
            k += 1
        yield at, end
        at = end + 1


def lex(line: str) -> list[Token]:
    """Tokens of one line, offsets from its start. The line number before a quoted line is no token."""
    out: list[Token] = []
    m = _GUTTER.match(line)
    at = m.end() if m else 0
    for p in _PEM.finditer(line) if "-----BEGIN" in line else ():
        _bare(line, at, 0, p.start(), out)
        out.append(Token(p[0], p.start(), "pem" if p[2].startswith("PRIVATE") else "public"))
        at = p.end()
    _bare(line, at, 0, len(line), out)
    return out


# --- features ---------------------------------------------------------------------------------

# Words that announce, qualify or exclude credentials.
SECRET_WORDS = frozenset("password passwd passwort passphrase pass pwd psw pw pin secret token authtoken apikey credential credentials creds jwt sid sessionid sessionkey kennwort schlüssel mdp clave senha contraseña parole accesskey secretkey privatekey identified bearer basic".split())
KEY_PARTNERS = frozenset("api access private signing sign secret account auth encryption service master storage license ssh tls ssl pem client hmac aes shared app session subscription deploy host".split())
KEY_OTHERS = frozenset("primary foreign cache partition sort public map lookup object row index dict json hot short group field unique join bucket".split())
QUALIFIERS = frozenset("hint length len min max age ttl expiry expires rotation days seconds minutes policy name id ids field label url uri path file expected public count limit type placeholder prompt tokenizer format enabled required missing env var ref header column param version at size rounds".split())
HASH_WORDS = frozenset("sha sha1 sha256 sha384 sha512 md5 etag commit digest checksum integrity hash fingerprint trace request uuid revision rev img image crc build span correlation asset thumbprint".split())
LOGIN_CALLS = frozenset("login authenticate auth connect signin configure credentials basicauth httpbasicauth logon setcredentials".split())
CRYPTO_CALLS = frozenset("createhmac hmac fromhex aes encrypt decrypt sign setkey secretkeyspec fernet createcipheriv unhexlify".split())
SOURCE_CALLS = frozenset("getenv environ env get read fetch vault getparameter formvalue param params args getproperty lookup input prompt split".split())
MESSAGE_CALLS = frozenset("error valueerror log info println print printf warn debug exception raise throw".split())
PLACEHOLDER = re.compile(r"(?i)your[ _-]|[_-]here\b|example|change[ _-]?me|insert|redact|placeholder|(?:^|[ _-])(?:dummy|todo|fixme)(?:$|[ _-])|<|>|^\[.*\]$|^(.)\1{3,}$|^[x*•.#-]{3,}$|enter |\bxxx|^(?:none|null|nil|undefined|empty|n/?a|true|false|test|secret|password|token)$|(?:^|[ _-])(?:masked|hidden|removed|sample|default)(?:$|[ _-])")
REFERENCE = re.compile(r"^[$@][A-Za-z_]\w*$|^%\w+%$|\$\{|\{\{|\$\(|%\(|^env[.:]|^vault:|^process\.|^os\.|^secrets?\.|^config\.|^settings\.|^ref[+:]|^arn:")
TOKEN_PREFIX = re.compile(r"^(?:AKIA|ASIA)[A-Z0-9]{12,}$|^(?:gh[pousr]_|github_pat_|glpat-|xox[abeprs]-|[sr]k_(?:live|test)_|AIza|ya29\.|npm_|pypi-|dop_v1_|hf_|SG\.|shp(?:at|ss)_)[\w.-]{8,}$|^[a-z]{2,8}(?:[_-][a-z]{2,6})?[_-](?:[0-9a-f]{6,}-)?(?=[\w-]*\d)(?=[\w-]*[A-Z])[\w-]{16,}$")
JWT = re.compile(r"^eyJ[\w-]{6,}\.[\w-]{6,}\.[\w-]*$")
HEX = re.compile(r"^[0-9a-fA-F]{16,}$")
UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|\d+")


#: Longer tokens and lines are not kept in the caches; they are read the same way.
LONGEST_KEPT = 200


def _kept(f: Callable) -> Callable:
    """Keep the results for short texts."""
    known = lru_cache(maxsize=50_000)(f)
    return lambda text, *more: known(text, *more) if len(text) <= LONGEST_KEPT else f(text, *more)


@_kept
def parts_of(name: str) -> tuple[str, ...]:
    return tuple(p.lower() for p in _PARTS.findall(name))


@_kept
def name_class(name: str) -> str:
    """What a name says about the value it governs."""
    p = parts_of(name)
    s = set(p)
    joined = "".join(p)
    if s & HASH_WORDS or (len(p) > 1 and p[-1].isdigit() and p[-2] == "sha"):
        return "hash"
    secret = bool(s & SECRET_WORDS) or joined in SECRET_WORDS or ("key" in s and bool(s & KEY_PARTNERS))
    if secret:
        return "qualified" if s & QUALIFIERS else "secret"
    if joined in ("key", "k") or (p and p[-1] == "key" and not s & KEY_OTHERS):
        return "key"
    if joined in ("user", "username", "login", "userid", "uid", "u"):
        return "user"
    if joined in CRYPTO_CALLS or s & CRYPTO_CALLS:
        return "crypto"
    if joined in LOGIN_CALLS or s & LOGIN_CALLS:
        return "login"
    if s & SOURCE_CALLS:
        return "source"
    if s & MESSAGE_CALLS:
        return "message"
    return "other"


#: Shapes a name can have; in others, parts of a value are not read as a name.
NAME_SHAPES = frozenset(("word", "identifier", "plain", "short", "placeholder", "mixcase"))


@_kept
def shape(value: str, quoted: bool) -> str:
    """Coarse shape of a literal."""
    if PLACEHOLDER.search(value):
        return "placeholder"
    if REFERENCE.search(value):
        return "reference"
    n = len(value)
    if value.isdigit():
        return "number"
    if JWT.match(value):
        return "jwt"
    if UUID.match(value):
        return "uuid"
    if HEX.match(value) and any(c.isdigit() for c in value):
        return "hex"
    if TOKEN_PREFIX.match(value):
        return "prefixed"
    low, up, dig = (sum(map(f, value)) for f in (str.islower, str.isupper, str.isdigit))
    special = n - low - up - dig
    if not dig and not special:
        return "mixcase" if n >= 8 and low and any(map(str.isupper, value[1:])) else "word"
    if re.fullmatch(r"[A-Za-z_$][A-Za-z_.$]*", value):
        return "identifier"
    if n >= 8 and n % 4 == 0 and re.fullmatch(r"[A-Za-z0-9+/]+={1,2}", value):
        return "base64"
    if n >= 20 and low and up and dig and re.fullmatch(r"[A-Za-z0-9+/_=-]+", value):
        return "random"
    if n >= 6 and (dig or special) and (low or up) and not re.search(r"[\\(){}\[\]]", value):
        if quoted and re.fullmatch(r"[a-z]+_[a-z]+_\d+", value):
            return "phrase"
        if re.fullmatch(r"[a-z_]+\d{0,2}|v?\d+(?:\.\d+)+|[\w.-]+\.(?:py|js|ts|go|rb|php|java|cfg|yml|yaml|json|txt|html|example|test|com|org|net|io)(?:[:/].*)?|/.*|\.\.?/.*", value):
            return "plain"
        return "mixed"
    return "short" if n < 6 else "other"


def governor(tokens: list[Token], i: int) -> tuple[str, str, int]:
    """(relation, name, index of the name) of what announces token i; index -1 if nothing does."""
    if tokens[i].kind == "urlpass":
        return "url", "password", -1
    j = i - 1
    while j >= 0 and tokens[j].kind == "quote":
        j -= 1
    if j < 0:
        return "none", "", -1
    t = tokens[j]
    if t.kind == "op":
        rel = "compare" if t.text in ("==", "===", "!=", "!==") else "assign"
        k = j - 1
        while k >= 0 and (tokens[k].kind == "quote" or tokens[k].text == "]"):
            k -= 1
        if k < 0:
            return rel, "", -1
        if tokens[k].kind in ("word", "string", "user", "flag"):
            name = tokens[k].text
            if name in ("value", "val", "default"):  # attribute pairs: the name stands in the other attribute
                for m in range(k - 1, -1, -1):
                    if tokens[m].kind == "string":
                        return "attribute", tokens[m].text, m
            if tokens[k].kind == "word" and rel == "assign" and t.text == ":" and k > 0 and tokens[k - 1].kind == "flag" and tokens[k - 1].text.lower() in ("-u", "--user"):
                return "userpair", "password", k - 1
            return rel, name, k
        return rel, "", -1
    if t.text in "(,":
        depth, k, arg = 0, j, 0
        while k >= 0:
            x = tokens[k].text
            if x == ")":
                depth += 1
            elif x == "(":
                if depth == 0:
                    break
                depth -= 1
            elif x == "," and depth == 0:
                arg += 1
            k -= 1
        if k > 0 and tokens[k - 1].kind == "word":
            return f"arg{min(arg, 2)}", tokens[k - 1].text.rsplit(".", 1)[-1], k - 1
        if k > 1 and tokens[k - 1].text == "=" and tokens[k - 2].kind == "word":  # auth=('user', 'value')
            return f"arg{min(arg, 2)}", tokens[k - 2].text, k - 2
        return f"arg{min(arg, 2)}", "", -1
    if t.kind in ("word", "flag"):
        if t.text.lower() in ("by", "is", "ist", "with"):
            if j > 0 and tokens[j - 1].kind == "word":
                return "beside", tokens[j - 1].text, j - 1
        return "beside", t.text, j
    return "none", t.text if len(t.text) == 1 else "", -1


def _first_name(tokens: list[Token]) -> str:
    for t in tokens:
        if t.kind in ("word", "string") and t.text[0].isalpha():
            return name_class(t.text)
    return "none"


def features(tokens: list[Token], context: str = "") -> list[list[str]]:
    """Feature names of each token. ``context``: marks of the surrounding lines (see ``contexts``)."""
    out = []
    first = _first_name(tokens)
    for i, t in enumerate(tokens):
        f = ["bias", f"kind={t.kind}"]
        if t.kind in ("punct", "op", "quote", "scheme", "host", "user", "public", "pem", "flag"):
            f.append(f"text={t.text.lower()}" if t.kind in ("punct", "op", "quote", "flag") else f"is={t.kind}")
        if t.kind in ("word", "string", "urlpass", "flag"):
            quoted = t.kind == "string" or (0 < i < len(tokens) - 1 and tokens[i - 1].kind == "quote")
            s = shape(t.text, quoted)
            rel, name, k = governor(tokens, i)
            c = name_class(name) if name else "none"
            if rel.startswith("arg") and name.lower() in LOGIN_CALLS:
                c = "login"
            elif name in ("-p", "-P"):
                c = "secret"
            if k > 0 and rel == "assign" and tokens[k].kind == "word" and tokens[k - 1].text == ":" and c == "key":
                c = "secret" if name_class(tokens[k - 2].text if k > 1 else "") == "secret" else c
            own = name_class(t.text) if t.text[0].isalpha() and s in NAME_SHAPES else "value"
            q = "quoted" if quoted else "bare"
            f += [f"shape={s}", f"own={own}", f"rel={rel}", f"name={c}", f"{rel}|{c}", f"{c}|{s}", f"{rel}|{c}|{s}|{q}"]
            if context:
                f += [f"ctx={context}|{rel}|{s}", f"ctx={context}|{rel}|{c}"]
            if t.text.lower() == name.lower() or (name and parts_of(t.text) == parts_of(name)):
                f.append("same-as-name")
            if first in ("hash", "source", "message"):
                f.append(f"line={first}|{s}")
            if i + 1 < len(tokens) and tokens[i + 1].text in "(.[" and t.kind == "word":
                f.append("callee")
            nxt = next((x for x in tokens[i + 1 :] if x.kind != "quote"), None)
            f.append(f"next={nxt.text if nxt and len(nxt.text) < 3 else 'end' if nxt is None else nxt.kind}|{own}")
        else:
            before = next((x for x in reversed(tokens[:i]) if x.kind in ("word", "string", "flag")), None)
            f.append(f"after={name_class(before.text) if before else 'none'}|{t.text if len(t.text) < 3 else t.kind}")
        out.append(f)
    return out


_K8S_SECRET = re.compile(r"(?m)^[^\S\n]*(?:[→>]?[^\S\n]*\d+ ?\| ?)?kind:[^\S\n]*Secret[^\S\n]*$")
_DATA_HEAD = re.compile(r"^\s*(?:[→>]?\s*\d+ ?\| ?)?(?:string)?[dD]ata:\s*$")
_ASSIGNED = re.compile(r"(?:^|[\s|])(?:const|let|var|final|String|auto|byte\[\])?\s*([A-Za-z_]\w*)\s*:?=\s*['\"]")
_KEYED = re.compile(r"(?i)(?:hmac|cipher\w*|secretkeyspec|aes(?:\.new)?|sign|encrypt|verify)\([^()\n]*?\b([A-Za-z_]\w*)\s*[,)]")
_KEY_USE = re.compile(r"(?i)hmac|cipher|keyspec|aes|sign\(|encrypt|verify\(")
_MAY_GO_ON = frozenset("+.\\")
_CONTINUES = re.compile(r"['\"]\s*(?:\+|\.|\\|\+\s*\\)\s*$")
_LITERAL_ONLY = re.compile(r"^\s*(?:[→>]?\s*\d+ ?\| ?)?\s*(?:[+.]\s*)?(['\"])[^'\"\s]+\1\s*[;,)]?\s*(?:[+\\.]\s*\\?)?\s*$")


def contexts(text: str, spans: list[tuple[int, int]]) -> list[str]:
    """A mark for each line: 'secretdata' below ``data:`` of a secret manifest, 'hmac' where the assigned
    name is used as a key elsewhere in the text, 'continued' for a literal that continues an announced one."""
    marks = [""] * len(spans)
    manifest = "Secret" in text and _K8S_SECRET.search(text) is not None
    keyed = set(_KEYED.findall(text)) if "(" in text and _KEY_USE.search(text) else set()
    below = False
    announced = False
    for n, (a, b) in enumerate(spans):
        line = text[a:b]
        if manifest and _DATA_HEAD.match(line):
            below = True
            continue
        if below:
            if re.match(r"^\s*(?:[→>]?\s*\d+ ?\| ?)?\s+[\w.-]+:\s*\S+\s*$", line):
                marks[n] = "secretdata"
                continue
            below = False
        if announced and _LITERAL_ONLY.match(line):
            marks[n] = "continued"
            announced = bool(_CONTINUES.search(line)) or line.rstrip().endswith(("+", "\\"))
            continue
        goes_on = line.rstrip()[-1:] in _MAY_GO_ON and _CONTINUES.search(line) is not None
        announced = False
        if (keyed or goes_on) and (m := _ASSIGNED.search(line)):
            if m[1] in keyed:
                marks[n] = "hmac"
            announced = goes_on and name_class(m[1]) == "secret"
    return marks


# --- model ------------------------------------------------------------------------------------


class Crf:
    """Linear-chain CRF: additive feature weights for each label and label transitions."""

    def __init__(self, weights: dict[str, list[float]], transitions: list[list[float]]) -> None:
        self.weights, self.transitions = weights, transitions

    @classmethod
    def load(cls) -> Crf:
        d = json.loads(pkgutil.get_data(__name__, MODEL.name))  # also from a zipped package
        return cls(d["weights"], d["transitions"])

    def viterbi(self, rows: list[list[str]]) -> list[int]:
        get, tr, k = self.weights.get, self.transitions, range(len(LABELS))
        score: list[float] = []
        back: list[list[int]] = []
        for n, row in enumerate(rows):
            e = [0.0] * len(LABELS)
            for f in row:
                if (w := get(f)) is not None:
                    for y in k:
                        e[y] += w[y]
            if n == 0:
                score = e
                continue
            best = [max(k, key=lambda x, y=y: score[x] + tr[x][y]) for y in k]
            score = [score[best[y]] + tr[best[y]][y] + e[y] for y in k]
            back.append(best)
        if not score:
            return []
        y = max(k, key=lambda x: score[x])
        path = [y]
        for best in reversed(back):
            y = best[y]
            path.append(y)
        return path[::-1]


@lru_cache(maxsize=1)
def model() -> Crf:
    return Crf.load()


_VALUE_KINDS = frozenset(("word", "string", "urlpass", "flag", "user"))
_READ_KINDS = frozenset(("punct", "op", "quote", "flag"))
_READ_WORDS = frozenset(("value", "val", "default", "by", "is", "ist", "with"))


@_kept
def _marks(text: str, kind: str, quoted: bool) -> tuple[tuple, tuple[tuple, ...]]:
    """What the features see of a token by itself, and what they compare with other tokens."""
    low, last = text.lower(), text.rsplit(".", 1)[-1]
    read = text if len(text) < 3 or text in _READ_WORDS else low if low in _READ_WORDS or kind == "flag" else ""
    own = (kind, quoted, read, text[0].isalpha(), shape(text, quoted), name_class(text), name_class(last) if last else "", low in LOGIN_CALLS, last.lower() in LOGIN_CALLS)
    same = (("l", low), ("p", parts_of(text)))
    return own, same if last == text else (*same, ("l", last.lower()), ("p", parts_of(last)))


def skeleton(tokens: list[Token], mark: str) -> tuple:
    """All that ``features`` reads of a line: lines of one skeleton have the same features."""
    seen: dict[tuple, int] = {("l", "password"): -1, ("p", ("password",)): -2}
    key: list = [mark]
    after_quote = False
    last = len(tokens) - 1
    for i, t in enumerate(tokens):
        kind = t.kind
        if kind in _VALUE_KINDS:
            own, compared = _marks(t.text, kind, kind == "string" or (after_quote and i < last))
            key.append(own)
            for x in compared:
                key.append(seen.setdefault(x, i))
        else:
            key.append((kind, t.text if len(t.text) < 3 or kind in _READ_KINDS else ""))
        after_quote = kind == "quote"
    return tuple(key)


_PATHS: dict[tuple, tuple[int, ...]] = {}
#: Paths a worker keeps; beyond that it starts anew.
MOST_PATHS = 50_000


@_kept
def _label(line: str, mark: str) -> list[tuple[int, int]]:
    tokens = lex(line)
    if not tokens:
        return []
    key = skeleton(tokens, mark)
    hits = _PATHS.get(key)
    if hits is None:
        hits = tuple(i for i, y in enumerate(model().viterbi(features(tokens, mark))) if y == 3)
        if len(key) <= LONGEST_KEPT:
            if len(_PATHS) >= MOST_PATHS:
                _PATHS.clear()
            _PATHS[key] = hits
    return [(tokens[i].start, tokens[i].end) for i in hits]


def find(text: str) -> list[tuple[int, int]]:
    """(start, end) of each credential in code points."""
    spans = list(lines(text))
    return [(a + x, a + y) for (a, b), mark in zip(spans, contexts(text, spans)) for x, y in _label(text[a:b], mark)]


# --- Spark ------------------------------------------------------------------------------------


#: Parts of a text's rows in the join.
SALTS = 8


def _locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(k, [{"start_pos": s, "end_pos": e} for s, e in f]) for k, t in zip(b["text_key"], b["text"]) if (f := find(t))]
        yield pd.DataFrame(rows, columns=["text_key", "spans"])


def _values(findings: DataFrame) -> DataFrame:
    """db_id, field_name, text, text_key of the non-empty values."""
    v = findings.select("db_id", F.inline(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in FIELDS])))
    return v.filter(F.col("db_id").isNotNull() & (F.col("text") != "")).withColumn("text_key", F.unhex(F.md5("text")))


def _texts(v: DataFrame) -> DataFrame:
    """Distinct texts: they repeat over scans."""
    return v.select("text", "text_key").distinct()


def _joined(v: DataFrame, hits: DataFrame, *columns: str | Column) -> DataFrame:
    """Values with the result of their text. A text that many rows quote is split: rows take one of SALTS parts of it, the result stands in all."""
    rows = v.select("db_id", "field_name", "text_key").distinct().withColumn("salt", F.pmod(F.xxhash64("db_id"), F.lit(SALTS)).cast("int"))
    hits = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(hits, ["text_key", "salt"]).select("db_id", "field_name", *columns)


def spans(findings: DataFrame) -> DataFrame:
    """db_id, field_name, start_pos, end_pos of each credential.

    Null and empty texts hold none; a row delivered twice counts once; rows without db_id are
    left out. Distinct texts are labelled once and joined back by their digest.
    """
    v = _values(findings)
    hits = _texts(v).mapInPandas(_locate, "text_key binary, spans array<struct<start_pos: int, end_pos: int>>")
    return _joined(v, hits, "spans").select("db_id", "field_name", F.inline("spans"))


def redact(text: str, found: list[tuple[int, int]] | None = None) -> str:
    """The text without its credentials and otherwise unchanged; a bare number becomes a number, all else a plain word."""
    out, at = [], 0
    for s, e in find(text) if found is None else found:
        bare_number = text[s:e].isdigit() and text[s - 1 : s] not in ("'", '"', "`")
        out += [text[at:s], REDACTED_NUMBER if bare_number else REDACTED]
        at = e
    return "".join(out) + text[at:]


def redacted(findings: DataFrame) -> DataFrame:
    """db_id, field_name, redacted text, number of credentials, for every value that holds one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, redact(t, f), len(f)) for k, t in zip(b["text_key"], b["text"]) if (f := find(t))]
            yield pd.DataFrame(rows, columns=["text_key", "text", "credentials"])

    v = _values(findings)
    clean = _texts(v).mapInPandas(run, "text_key binary, text string, credentials int")
    return _joined(v, clean, F.col("text").alias("redacted_text"), "credentials")
