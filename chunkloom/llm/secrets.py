"""Credentials in code and configuration, found by a conditional random field over lexical tokens.

A line is cut into tokens: names, marks, and the pieces of its literals and values. Each token has features of its
shape and of what stands around it, above all the name the value goes to. The field, trained on lines made by rule,
labels the tokens; the labelled spans say which characters are redacted.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.crf import Chain, hashed, train
from chunkloom.session import spread

MASK = "*****"
#: A line without any of these holds no literal and no value that goes to a name; the field reads all others. What is
#: called or indexed right after a sign is code, no value.
SIGN = re.compile(r"""["'`@]|[=:>]\s*(?![\w.]++[(\[])[^\s=:>({\[]""")
TOKEN = re.compile(
    r"""
    (?P<pem>-----(?:BEGIN|END)\ [A-Z0-9 ]+-----)
  | (?P<quote>\"\"\"|'''|["'`])
  | (?P<scheme>[a-zA-Z][a-zA-Z0-9+.-]*://)
  | (?P<tag></?[\w.:-]+|/?>)
  | (?P<mask>[*•]{3,}|[xX]{6,}(?![\w])|\$\{[^}\n]*\}|\$\([^)\n]*\)|\{\{[^}\n]*\}\}|%\([\w.]+\)s|<[\w][\w .:-]*>)
  | (?P<word>[\w+/.%!\#$^&*~=@?|\\-]++(?=["'`\s,;:(){}\[\]<>]|$))
  | (?P<space>\s+)
  | (?P<mark>.)
    """,
    re.X | re.S,
)
NAME = re.compile(r"^[A-Za-z_][\w.-]*$")
WORDY = re.compile(r"\w").search
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: Parts of names that hold credentials, parts that hold something else, and text that stands for a value.
SECRET_PARTS = frozenset("pass password passwd passphrase passcode pwd pw secret secrets token tokens key apikey auth authorization credential credentials cred creds private signing encryption webhook access client jwt bearer dsn api pem smtp db".split())
CORE_PARTS = frozenset("pass password passwd passphrase passcode pwd pw secret secrets token tokens apikey credential credentials cred creds auth authorization jwt bearer pem key".split())
OTHER_PARTS = frozenset(
    "public pub sha sha1 sha256 sha512 md5 hash checksum digest commit integrity etag request trace span id uuid guid name path file dir url uri host port max min count limit size mode ttl ref type kind prefix suffix header field column index version fingerprint env var label title hint help placeholder table blob data bytes length expiry expires at primary foreign sort cache revision".split()
)
STAND_INS = re.compile(
    r"(?i)(?<![a-z0-9])your(?![a-z0-9])|change[-_ ]?me|^\W*(?:example|sample|dummy|fake|placeholder|redacted|hidden|masked|removed|none|null|nil|true|false|todo|tbd|undefined|insert|secret|password|passwd|token|string|str|optional|required|default|test|xxx+|n/?a)\W*$|insert[-_ ]|replace[-_ ]|_here\b|^(.)\1{5,}$|^<.*>$|^\$|^%\(|^\{\{|^(?:vault|env|ssm|secretsmanager|op|aws|gcp|kms|azure|keychain|file|secret|ref|arn):|^os\.|^process\.env|^ENC\["
)
PREFIXES = re.compile(r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk[_-](?:live|test|proj)|sk-|pk_live|rk_live|xox[abprs]-|eyJ|ya29\.|AIza|SG\.|npm_|hf_|dop_v1|tok_|shpat_)")
NOT_SECRET = re.compile(r"^(?:ssh-(?:rsa|ed25519|dss)|ecdsa-)|^sha\d+[:-]|^md5:|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)


def lex(line: str) -> list[tuple[str, int, str, bool]]:
    """(text, start, kind, quoted) of the tokens of a line, blanks left out.

    Logins in addresses and after -u, and values of parameters in addresses, become tokens of their own; outside of
    quotes an equals sign parts a name from its value, but not the end of a base64 value.
    """
    out: list[tuple[str, int, str, bool]] = []
    quote, in_url = "", False

    def add(text: str, at: int, kind: str) -> None:
        if text:
            out.append((text, at, kind, bool(quote)))

    for m in TOKEN.finditer(line):
        kind, text, at = m.lastgroup, m.group(), m.start()
        if kind == "space":
            in_url = False
            continue
        if kind == "quote":
            if not quote:
                quote = text
            elif text == quote:
                quote = ""
            in_url = False
            out.append((text, at, "quote", False))
            continue
        if kind == "scheme":
            in_url = True
            add(text, at, "scheme")
            continue
        if kind == "word":
            if in_url and "@" in text and out and (out[-1][0] == ":" or out[-1][2] == "scheme"):
                i = text.rindex("@")
                add(text[:i], at, "word")
                add("@", at + i, "mark")
                text, at = text[i + 1 :], at + i + 1
            if in_url and ("?" in text or "&" in text):
                for p in re.finditer(r"[?&]|=|[^?&=]+(?:={1,2}(?=$|&))?", text):
                    add(p.group(), at + p.start(), "mark" if p.group() in "?&=" else "word")
                continue
            if not in_url and "=" in text.rstrip("="):
                i = text.index("=")
                name, value = text[:i], text[i + 1 :]
                if i == 0 or NAME.match(name) and (not quote or len(name) < 30):
                    add(name, at, "word")
                    add("=", at + i, "mark")
                    if value and value[0] not in "=":
                        add(value, at + i + 1, "word")
                    else:
                        add(value, at + i + 1, "mark")
                    continue
            if not quote and text.endswith("=") and NAME.match(text[:-1]) and not (out and out[-1][0] in ("=", ":", ">")):
                add(text[:-1], at, "word")
                add("=", at + len(text) - 1, "mark")
                continue
            out.append((text, at, "word" if WORDY(text) or quote and len(text) > 2 else "mark", bool(quote)))
            continue
        out.append((text, at, kind, bool(quote)))
    return out


@lru_cache(maxsize=100_000)
def shape(text: str) -> tuple[str, ...]:
    """Features of a token by itself."""
    n = len(text)
    lower, upper, digit = (any(c in s for c in text) for s in (string.ascii_lowercase, string.ascii_uppercase, string.digits))
    sign = any(not c.isalnum() for c in text)
    freq = Counter(text)
    entropy = -sum(c / n * math.log2(c / n) for c in freq.values()) if n else 0
    f = [f"len{min(n, 40) // 4}", f"mix{lower:d}{upper:d}{digit:d}{sign:d}", f"ent{int(entropy * 2)}"]
    if STAND_INS.search(text):
        f.append("standin")
    if PREFIXES.match(text):
        f.append("prefix")
    if NOT_SECRET.match(text):
        f.append("known_other")
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) and n >= 24:
        f.append("hex")
    if re.fullmatch(r"-?[\d._]+", text):
        f.append("number")
    elif re.fullmatch(r"[a-z_]+|[A-Z_]+|[A-Z][a-z]+", text):
        f.append("plain")
    elif n >= 14 and lower + upper + digit == 3:
        f.append("mixed")
    if re.fullmatch(r"(?:[a-z]+-){2,}[a-z]+\d{0,4}", text):
        f.append("phrase")
    if re.fullmatch(r"[A-Za-z]+[^\w\s]\d+\w{0,3}|[A-Za-z]+\d+[^\w\s]+\w{0,3}|[A-Z][a-z]+_\d{3,}\w{0,2}", text):
        f.append("wordnum")
    if text.startswith("/") or re.search(r"^\w+(?:[./]\w+)+$", text) and not digit:
        f.append("path")
    return tuple(f)


def parts(name: str) -> set[str]:
    return {p.lower() for p in PARTS.findall(name)}


@lru_cache(maxsize=50_000)
def kind_of_name(name: str) -> str:
    """Whether a name is that of a credential: secret, other or none.

    What counts is its last word, numbers and one or two letters after it left aside: a token_span is no token.
    """
    p = [x.lower() for x in PARTS.findall(name)]
    while len(p) > 1 and (len(p[-1]) <= 2 and p[-1] not in ("pw", "id") or p[-1].isdigit() or p[-1] in ("pem", "header", "value", "val", "b64", "hex", "raw", "default", "string")):
        p.pop()
    if not p:
        return "none"
    last = re.sub(r"^(pass(?:word|wd|phrase|code)?|pwd|secrets?|tokens?|key|apikey|credentials?|creds?|auth|jwt)[a-z]{1,2}$", r"\1", p[-1])
    before = set(p[:-1])
    if last in ("key", "pem"):
        if before & {"public", "pub", "primary", "foreign", "sort", "cache", "max", "partition"}:
            return "other"
        return "secret" if before & {"api", "secret", "private", "signing", "encryption", "access", "auth", "master", "client", "service", "ssh", "hmac", "jwt", "account", "storage", "crypto", "webhook", "app", "admin", "license", "rsa"} else "none"
    if last in CORE_PARTS or re.search(r"(?:password|passwd|passphrase|secret|apikey|authtoken|accesstoken|secretkey|privatekey|smtppass|dbpass)[a-z]{0,2}$", "".join(p)):
        return "other" if before & {"max", "min", "num", "public", "total", "count"} else "secret"
    return "other" if last in OTHER_PARTS or before & CORE_PARTS else "none"


def context(tokens: list[tuple[str, int, str, bool]], i: int) -> tuple[str, str, str, int]:
    """(name, how, call, arg): the name a value goes to, the sign between, the function around it, and its place there."""
    j, depth, commas, name, how, call = i - 1, 0, 0, "", "", ""
    while j >= 0 and i - j < 40:
        t, _, kind, quoted = tokens[j]
        if kind in ("mark", "tag") or t in ("?", "&"):
            if t in ")]}":
                depth += 1
            elif t in "([{":
                if depth:
                    depth -= 1
                elif t == "(":
                    k = j - 1
                    if k >= 0 and tokens[k][2] == "word":
                        call = tokens[k][0]
                        if not name and how == "" and commas == 0 and k >= 2 and tokens[k - 1][0] in ("=", ":"):
                            name, how = tokens[k - 2][0], "call"
                    elif not name and k >= 1 and tokens[k][0] in ("=", ":"):
                        name, how = next((tokens[q][0] for q in range(k - 1, -1, -1) if tokens[q][2] == "word"), ""), "tuple"
                    break
            elif t == "," and not depth:
                commas += 1
                if name:
                    break
            elif t in ("=", ":", ">") and not depth and not how and not commas:
                how = t
            elif kind == "tag" and t[1:2] not in ("/", "") and how == ">" and not name:
                name = t[1:]
                break
            elif t in "+" and not depth:
                pass
        elif kind == "word" and how in ("=", ":", ">") and not name and not (quoted and how == ":" and tokens[i][3] and all(x[2] != "quote" for x in tokens[j:i])):
            name = t
            if how != "=":
                break
        elif kind == "word" and how == ":" and not name:
            name = t
            break
        j -= 1
    return name, how, call, commas


@lru_cache(maxsize=50_000)
def kind_of_call(call: str) -> tuple[bool, bool, bool]:
    """(logs in, reads from elsewhere, looks up by get) of the function around a value."""
    last = call.lower().rsplit(".", 1)[-1]
    reads = bool(re.search(r"getpass|getenv|read|fetch|load|lookup|input|prompt|environ|decrypt|info|debug|warning|error|print|log|exception", call.lower()))
    return bool(re.search(r"login|sign_?in|auth|connect|credential", last)), reads, last == "get"


NOTHING = ("", 0, "", False)
ISNAME, VALUED = frozenset(["=", ":", "(", "[", "."]), frozenset(["=", ":", ">"])


def groups(tokens: list[tuple[str, int, str, bool]]) -> Iterator[list[tuple]]:
    """For every token of a line the groups of features that it has; spelled() names the features of a group."""
    for i, (text, _, kind, quoted) in enumerate(tokens):
        if kind == "pem":
            yield [("pem", quoted, "BEGIN" in text and "PRIVATE KEY" in text)]
            continue
        if kind != "word":
            yield [("sign", quoted, kind, text[:3])]
            continue
        name, how, call, arg = context(tokens, i)
        nk = kind_of_name(name) if name else "no"
        near = tokens[i - 1] if i else NOTHING
        if near[2] == "quote":
            near = next((x for x in tokens[max(0, i - 3) : i][::-1] if x[2] != "quote"), NOTHING)
        before = near[0]
        right = next((x[0] for x in tokens[i + 1 : i + 4] if x[2] != "quote"), "")
        # the password in `-u name:password`, which ends no name
        user = before == ":" and [x[0] for x in tokens[max(0, i - 3) : i] if x[2] != "quote"][-3:-2] in (["-u"], ["--user"])
        is_name = right in ISNAME and not (right == ":" and before == "-u")
        g: list[tuple] = [("own", text, quoted, is_name), ("name", text, nk, how, quoted or how in VALUED)]
        if near[2] == "word" and before.lower() in ("bearer", "basic", "token"):
            g.append(("scheme", text))
        if right == "@" and before == ":":
            g.append(("login", text))
        elif right == "@" or before == "@":
            g.append(("host",))
        if user:
            g.append(("u", text))
        if before == "/" and any(re.search(r"login|account|cred", x[0].lower()) for x in tokens[max(0, i - 5) : i]):
            g.append(("slash", text))
        if call:
            login, reads, get = kind_of_call(call)
            g.append(("call", text, nk, login, min(arg, 2), reads or get and arg == 0, get and arg >= 1))
        if how == "tuple":
            g.append(("tuple", text, nk, min(arg, 8)))
        yield g


def spelled(group: tuple) -> list[str]:
    """The names of the features of a group."""
    kind, *x = group
    if kind == "pem":
        return ["bias", f"kpem{x[0]:d}", "pem_private" if x[1] else "pem_other"]
    if kind == "sign":
        return ["bias", f"k{x[1]}{x[0]:d}", f"t{x[2]}"]
    if kind == "host":
        return ["host_or_user"]
    own = shape(x[0])
    if kind == "own":
        return ["bias", f"kword{x[1]:d}", f"isname{x[2]:d}", *own, *[f"standin_q{x[1]:d}"] * ("standin" in own)]
    if kind == "name":
        _, nk, how, value = x
        return [f"name_{nk}", f"how{how}_{nk}", f"value{value:d}_{nk}", *[f"{s}_{nk}_{value:d}" for s in own]]
    if kind == "call":
        _, nk, login, arg, reads, fallback = x
        f = [f"login{login:d}_arg{arg}_{nk}", f"reads{reads:d}", f"reads{reads:d}_{nk}"]
        f += ["fallback", *[f"fallback_{s}" for s in own]] * fallback
        return f + [f"login_arg{arg}_{s}" for s in own] * login
    if kind == "tuple":
        return [f"tuple{x[2]}_{x[1]}", *[f"tuple{x[2]}_{x[1]}_{s}" for s in own]]
    return [f"{kind}_word", *[f"{kind}_{s}" for s in own]]


def features(tokens: list[tuple[str, int, str, bool]]) -> list[list[int]]:
    """The hashed features of every token of a line."""
    return [[hashed(f) for x in g for f in spelled(x)] for g in groups(tokens)]


# training lines, made by rule

WORDS = "amber orchid falcon willow copper meadow harbour lantern violet granite maple raven comet tulip saffron pepper canyon meteor walnut silver".split()
SERVICES = "billing orders mailer gateway reports archive metrics search payment catalog profile upload".split()
SECRET_NAMES = "password passwd db_password db_pass admin_password PASSWORD pwd pw smtp_pass smtp_password passphrase PASSPHRASE secret SECRET client_secret CLIENT_SECRET webhook_secret app_secret token TOKEN access_token auth_token AUTH_TOKEN svc_token private_token api_token apiToken api_key API_KEY apikey apiKey signing_key SIGNING_KEY encryption_key secret_key SECRET_KEY private_key credential credentials authToken auth.token access_key jwt_secret".split()
OTHER_NAMES = "name mode path url host title label color status region version commit commit_sha checksum sha256 digest etag request_id trace_id integrity fingerprint public_key secret_name token_path key_name cache_key sort_key primary_key token_type max_tokens token_limit password_hint password_field session_mode key_prefix secret_ref token_count size limit icon locale theme user username text value tag revision build data payload window state row token_index key_column auth_mode auth_url key_size secret_path token_ttl password_length".split()


def _chars(r: random.Random, alphabet: str, low: int, high: int) -> str:
    return "".join(r.choice(alphabet) for _ in range(r.randint(low, high)))


def _credential(r: random.Random) -> str:
    a = string.ascii_letters + string.digits
    return r.choice(
        [
            lambda: _chars(r, a, 14, 40),
            lambda: _chars(r, a + "!%_#-$^&*", 10, 20),
            lambda: _chars(r, a + "+/", 40, 44) + r.choice(["=", "==", ""]),
            lambda: _chars(r, "0123456789abcdef", 32, 32),
            lambda: _chars(r, "0123456789abcdef", 40, 40),
            lambda: _chars(r, "0123456789abcdef", 64, 64),
            lambda: "-".join(r.sample(WORDS, 3)) + str(r.randint(1, 99)),
            lambda: r.choice(WORDS).title() + r.choice("!-%#__@$.") + str(r.randint(100, 999999)) + r.choice(["", "x", "a", "qz"]),
            lambda: r.choice(["AKIA", "ASIA"]) + _chars(r, string.ascii_uppercase + "234567", 16, 16),
            lambda: r.choice(["ghp_", "gho_", "glpat-", "sk_live_", "sk-", "xoxb-", "tok_", "npm_", "hf_", "rk-prod-", "abc."]) + _chars(r, a, 20, 40),
            lambda: "eyJ" + _chars(r, a, 15, 30) + ".eyJ" + _chars(r, a + "-_", 20, 40) + "." + _chars(r, a + "-_", 30, 45),
        ]
    )()


def _stand_in(r: random.Random) -> str:
    return r.choice(["<your-password>", "<token>", "<insert-key>", "YOUR_TOKEN_HERE", "your-api-key", "CHANGE_ME", "CHANGE_ME_PLEASE", "changeme", "********", "xxxxxxxxxxxxxxxx", "XXXXXXXX", "${DB_PASSWORD}", "$TOKEN", "{{ secret }}", "vault:kv/" + r.choice(WORDS), "env:API_KEY", "secretsmanager:" + r.choice(SERVICES), "example", "REDACTED", "placeholder", "insert-key-here", "...", "", "none", "todo", "%(password)s", "dummy", "replace_with_real_key"])


def _plain_value(r: random.Random) -> str:
    a = string.ascii_letters + string.digits
    return r.choice(
        [
            lambda: r.choice(WORDS),
            lambda: f"/srv/{r.choice(WORDS)}/{r.choice(SERVICES)}",
            lambda: f"https://{r.choice(SERVICES)}{r.randint(1, 40)}.{r.choice(WORDS)}.example/",
            lambda: str(r.randint(1, 9999)),
            lambda: f"{r.choice(WORDS)}_{r.choice(WORDS)}",
            lambda: f"{r.choice(WORDS)} {r.choice(SERVICES)} {r.choice(WORDS)}",
            lambda: f"{r.choice(SERVICES)}/{r.choice(WORDS)}/credentials",
            lambda: f"{r.choice(WORDS)}.py",
            lambda: f"{r.choice(WORDS)}{r.randint(1, 900)}",
            lambda: f"v{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 9)}",
            lambda: f"{r.choice(WORDS)}-{r.choice(WORDS)}",
        ]
    )()


def _digest(r: random.Random) -> tuple[str, str]:
    h = lambda n: _chars(r, "0123456789abcdef", n, n)
    return r.choice(
        [
            lambda: (r.choice(["commit_sha", "commit", "revision", "git_sha", "head_sha", "parent_commit"]), h(40)),
            lambda: (r.choice(["checksum", "sha256", "digest", "content_hash", "etag", "file_hash"]), r.choice(["sha256:", "", "md5:", "sha1:"]) + h(r.choice([32, 64]))),
            lambda: (r.choice(["request_id", "trace_id", "correlation_id", "session_uuid", "id", "run_id"]), f"{h(8)}-{h(4)}-{h(4)}-{h(4)}-{h(12)}"),
            lambda: (r.choice(["integrity", "hash"]), "sha384-" + _chars(r, string.ascii_letters + string.digits + "+/", 64, 64)),
            lambda: (r.choice(["public_key", "pubkey", "PUBLIC_KEY", "ssh_public_key"]), "ssh-ed25519 " + _chars(r, string.ascii_letters + string.digits + "+/", 60, 68) + " " + r.choice(WORDS)),
            lambda: (r.choice(["build_id", "image_digest", "layer_digest", "fingerprint"]), h(r.choice([32, 40, 64]))),
        ]
    )()


def made_line(r: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A line of code or configuration and the spans of its secrets. § marks a value in the patterns below."""
    q = r.choice("\"'")
    kind = r.random()
    secret = kind < 0.5
    value = _credential(r)
    name = r.choice(SECRET_NAMES) + (r.choice(["", "", "_" + _chars(r, string.ascii_lowercase + string.digits, 1, 2), _chars(r, string.ascii_lowercase + string.digits, 2, 2)]))
    name_ = name
    service = r.choice(SERVICES)
    host = f"{service}{r.randint(1, 40)}.{r.choice(WORDS)}.example"
    value_of = [
        f"{name} = {q}§{q}",
        f"{name}={q}§{q},",
        f"{name}: {q}§{q}",
        f"const {name} = {q}§{q};",
        f'"{name}": "§",',
        f'{{"user": "{service}", "{name}": "§"}}',
        f"{name}=§",
        f"{name}: §",
        f'<entry name="{name}">§</entry>',
        f"<{name}>§</{name}>",
        f"config[{q}{service}{q}][{q}{name}{q}] = {q}§{q}  # note",
        f"client = connect({q}{host}{q}, user={q}{service}{q}, {name}={q}§{q})",
        f"self.{name} = {q}§{q}",
        f"export {name.upper()}={q}§{q}",
        f"const cfg = {{ user: {q}{service}{q}, {name}: {q}§{q} }};",
        f"# {name}: §",
        f"{name} = (",
    ]
    if secret and r.random() < 0.1:  # short passwords and those of several words, which only the name tells
        name = r.choice(["password", "passwd", "pwd", "pw", "PASSWORD", "db_password", "passphrase", "secret", "kennwort_pw", "admin_password", "smtp_pass"])
        value = r.choice([_chars(r, string.ascii_lowercase + string.digits + "!?%#", 4, 8), _chars(r, string.ascii_letters + string.digits, 5, 8), _chars(r, string.ascii_lowercase, 5, 9), " ".join(r.sample(WORDS, r.randint(2, 5)))])
        if r.random() < 0.3:  # the other way round: only the value tells
            name = r.choice(WORDS)[: r.randint(2, 6)] + r.choice(["", "conf", "wort", "_cfg", "2", "x"])
            value = _chars(r, string.ascii_letters + string.digits, 3, 5) + r.choice("%!$&^") + _chars(r, string.ascii_letters + string.digits + "%!#$&^", 6, 12)
        quoted = " " in value
        pattern = r.choice(value_of[:4] + value_of[8:9] + value_of[:1] * 2 if quoted else value_of[:9]).replace(name_, name)
    elif secret:
        special = [
            f"headers = {{{q}Authorization{q}: {q}Bearer §{q}, {q}Accept{q}: {q}*/*{q}}}",
            f"request.headers[{q}Authorization{q}] = {q}Basic §{q}",
            f"axios.defaults.headers[{q}X-Auth{q}] = {q}§{q};",
            f"dsn = {q}{r.choice(['postgresql', 'mysql', 'redis', 'amqp', 'mongodb+srv'])}://{r.choice(WORDS)}:§@{host}:{r.randint(1000, 9999)}/{service}{q}",
            f"url = {q}https://{r.choice(WORDS)}:§@{host}/{service}{q}",
            f"url = {q}https://{host}/v2/{service}?limit=20&{r.choice(['access_token', 'api_key', 'token', 'key', 'auth'])}=§{q}",
            f"run({q}curl -s -u {service}:§ https://{host}/api{q})",
            f"{r.choice(['login', 'client.login', 'sign_in', 'session.authenticate'])}({q}{service}{q}, {q}§{q})",
            f"{r.choice(['auth', 'credentials', 'basic_auth', 'creds'])} = ({q}{service}-bot{q}, {q}§{q})",
            f"{name} = os.environ.get({q}{name.upper()}{q}, {q}§{q})",
            f"{name} = os.getenv({q}{name.upper()}{q}, {q}§{q})",
            f"const {name} = process.env.{name.upper()} || {q}§{q};",
            f"{name} = {q}§{q} + {q}§{q}",
            f"{name}_pem = {q * 3}§",
            f"{r.choice(['#', '//'])} {r.choice(WORDS)}, {r.choice(WORDS)} {r.choice(['login', 'credentials', 'account'])}: {service} / §",
        ]
        special += special[7:9] * 2 + special[12:13] + special[-1:]  # logins, pairs, joined parts and remarks vary most
        pattern = r.choice(special) if r.random() < 0.55 else r.choice(value_of[:16])
        if pattern.endswith(q * 3 + "§"):
            value = f"-----BEGIN {r.choice(['', 'RSA ', 'OPENSSH ', 'EC '])}PRIVATE KEY-----"
        if "@" in pattern and "://" in pattern or " -u " in pattern:
            value = _chars(r, string.ascii_letters + string.digits, 10, 20) if r.random() < 0.8 else re.sub(r"[^\w.!-]", "", _credential(r))
    elif kind < 0.68:  # a name of a credential without one
        value = _stand_in(r)
        pattern = r.choice(
            [
                *value_of,
                f"{name} = os.environ[{q}{service.upper()}_KEY{q}]",
                f"{name} = os.environ.get({q}{name.upper()}{q})",
                f"{name} = getpass({q}Password: {q})",
                f"{name} = {r.choice(['vault.read', 'secrets.fetch', 'keyring.get_password', 'load_secret'])}({q}{service}/{r.choice(WORDS)}{q})",
                f"dsn = f{q}postgresql://{{user}}:{{password}}@{{host}}/{service}{q}",
                f"url = {q}https://{host}/?token=§{q}",
                f"const {name} = process.env.{name.upper()};",
                f"{name}_pem = {q * 3}-----BEGIN PUBLIC KEY-----",
                f"login({q}{service}{q}, password)",
                f"headers = {{{q}Authorization{q}: f{q}Bearer {{token}}{q}}}",
                f"def check({name}, {r.choice(WORDS)}=None):",
                f"if {name} == {q}{q}:",
                f"for {r.choice(WORDS)} in {name}:",
                f"logger.info({q}{r.choice(WORDS)} {name} {r.choice(WORDS)} %s{q}, {r.choice(WORDS)})",
                f"{name} = {r.choice(WORDS)}({r.choice(WORDS)}, {r.randint(1, 99)})",
                f"{name} = {r.choice(WORDS)} * {r.randint(1, 99)}",
                f"{name}={r.randint(1, 9999)}",
                f"{name}: https://{host}/",
                f'"{name}_url": "https://{host}/",',
                f"{name}_{r.choice(WORDS)} = sum(len(str(v)) for v in {r.choice(WORDS)}) % {r.randint(1, 999)}",
                f"raise ValueError({q}{name} is missing{q})",
            ]
        )
        secret = False
    elif kind < 0.82:
        name, value = _digest(r)
        pattern = r.choice([f"{name} = {q}§{q}", f'"{name}": "§",', f"{name}: §", f"{name}={q}§{q}", f"const {name} = {q}§{q};", f'<entry name="{name}">§</entry>', f"# source {name} §", f"// @generated SignedSource<<{_chars(r, '0123456789abcdef', 32, 32)}>>"])
    else:
        name = r.choice(OTHER_NAMES) + r.choice(["", str(r.randint(1, 99))])
        value = _plain_value(r)
        pattern = r.choice(
            [
                f"{name} = {q}§{q}",
                f'"{name}": "§",',
                f"{name}: §",
                f"{name.upper()}=§",
                f'<entry name="{name}">§</entry>',
                f"const {name} = {q}§{q};",
                f"open_{r.choice(WORDS)}({q}§{q}, {q}{r.choice(WORDS)}{q})",
                f"{r.choice(WORDS)} = {r.choice(WORDS)}({r.choice(WORDS)}, {name}={q}§{q})",
                f"client = connect({q}{host}{q}, user={q}{service}{q})",
                f"assert isinstance({r.choice(WORDS)}, (list, dict, str)), {q}{r.choice(WORDS)} type{q}",
                f"{q}{_chars(r, string.ascii_letters + string.digits + '+/', 60, 100)}{q}",
                f"{r.choice(WORDS)}_total = sum(len(str(v)) for v in {r.choice(WORDS)}) % {r.randint(1, 999)}",
                f"logger.warning({q}{r.choice(WORDS)} {r.choice(WORDS)} token %s{q}, {r.choice(WORDS)})",
                f"from {r.choice(WORDS)}.{r.choice(SERVICES)} import {r.choice(WORDS)}_{r.choice(WORDS)}",
                f"return {{ {r.choice(WORDS)}: {r.choice(WORDS)}, depth: depth + 1, tag: {q}{r.choice(WORDS)}{r.randint(1, 900)}{q} }};",
                f"'''Callers must hold the {r.choice(WORDS)} lock; otherwise the key may be read twice.",
            ]
        )
    indent = " " * r.choice([0, 0, 2, 4, 8])
    line, spans, parted = indent, [], pattern.count("§")
    for k, piece in enumerate(pattern.split("§")):
        if k:
            v = value if parted == 1 else value[: len(value) // 2] if k == 1 else value[len(value) // 2 :]
            if secret:
                spans.append((len(line), len(line) + len(v)))
            line += v
        line += piece
    return line, spans


@cache
def field(lines: int = 6000, seed: int = 5) -> Chain:
    """The trained field; one training per process, on lines made by rule, so it is the same everywhere."""
    r = random.Random(seed)
    xs, ys = [], []
    for _ in range(lines):
        line, spans = made_line(r)
        t = lex(line)
        if not t or len(t) > 48:
            continue
        xs.append(features(t))
        ys.append([int(k[2] != "quote" and any(a <= k[1] < b for a, b in spans)) for k in t])
    return train(xs, ys)


#: A private key up to its end mark, as it stands in texts, string literals and lists of them; and, where something else
#: than a key comes before an end mark, the lines right after its head that can belong to it.
WHOLE_KEY = re.compile(r"""-----BEGIN [A-Z0-9 ]+-----(?:[A-Za-z0-9+/\s"'`,\\().]|=(?=[=\r\n"'`\\])|(?:Proc-Type|DEK-Info|Comment|Version):[^\n]*)*?-----END [A-Z0-9 ]+-----""")
PART_KEY = re.compile(r"""-----BEGIN [A-Z0-9 ]+-----(?:(?:\\[rn]|[ \t]*\r?\n[ \t]*)++[A-Za-z0-9+/=]++(?=[ \t]*(?:[\r\n"'`]|\\[rn]|\Z)))*+""")
OPENS = ("(", "[", "{", "\\")
CLOSES = (")", "]", "}")
STATEMENTS = ("def ", "class ", "if ", "for ", "while ", "return ", "else", "try", "with ")


class Finder:
    """Spans of secrets in texts, for one trained field; lines that were seen before are remembered."""

    def __init__(self, chain: Chain):
        self.chain = chain
        emit = chain.emit.tolist()
        self.group = lru_cache(maxsize=400_000)(lambda g: sum([emit[hashed(f)] for f in spelled(g)]))
        self.line = lru_cache(maxsize=200_000)(self._line)
        s00, s01, s10, s11 = chain.steps
        #: Where no token scores more, no run of label 1 scores above label 0 throughout, whatever its length.
        self.least = -(s11 - s00) - max(0.0, s01 + s10 - s11 - s00)

    def _line(self, head: str, line: str) -> tuple[tuple[int, int], ...]:
        """Spans in line; head is what it continues, or empty."""
        t = lex(head + line)
        group = self.group
        scores = [sum(map(group, g)) for g in groups(t)]
        if max(scores, default=0.0) <= self.least:
            return ()
        labels = self.chain.best(scores)
        spans: list[tuple[int, int]] = []
        for (text, at, kind, _), y in zip(t, labels, strict=True):
            at -= len(head)
            if not y or at < 0:
                continue
            if spans and not line[spans[-1][1] : at].strip():  # the words of one value
                spans[-1] = (spans[-1][0], at + len(text))
            elif kind in ("word", "pem"):
                spans.append((at, at + len(text)))
        return tuple(spans)

    def spans(self, content: str) -> list[tuple[int, int, int]]:
        """(line number, start, end) in content of every secret; a private key reaches to its end mark or its last line.

        A line that ends in an open bracket or a backslash is the head of all lines that follow, up to the line that
        closes the bracket or the first without a backslash.
        """
        out: list[tuple[int, int, int]] = []
        start, skip, head, joined = 0, 0, "", False
        for no, text in enumerate(content.split("\n"), 1):
            begin, start = start, start + len(text) + 1
            if begin < skip:
                continue
            if SIGN.search(text) or "-----BEGIN" in text:
                for a, b in self.line(head, text):
                    if content.startswith("-----BEGIN", begin + a):
                        key = WHOLE_KEY.match(content, begin + a) or PART_KEY.match(content, begin + a)
                        skip = key.end() if key else begin + b
                        out.append((no, begin + a, skip))
                        break
                    out.append((no, begin + a, begin + b))
            bare = text.strip()
            if head:
                if joined and not bare.endswith("\\") or not joined and bare.startswith(CLOSES) or not joined and bare.count("(") + bare.count("[") < bare.count(")") + bare.count("]"):
                    head = ""
            elif bare.endswith(OPENS) and ("=" in bare or ":" in bare) and not bare.startswith(STATEMENTS):
                head, joined = bare + " ", bare.endswith("\\")
        return out


def _run(batches: Iterator[pa.RecordBatch], weights, redact: bool) -> Iterator[pa.RecordBatch]:
    finder = Finder(Chain(*weights.value))
    for b in batches:
        ids, lines, texts, counts = [], [], [], []
        for i, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = finder.spans(content)
            if redact:
                for _, a, z in reversed(found):
                    content = content[:a] + MASK + content[z:]
                ids.append(i)
                texts.append(content)
                counts.append(len(found))
            else:
                for no, _, _ in found:
                    ids.append(i)
                    lines.append(no)
        if redact:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["chunk_id", "content", "secrets"])
        else:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(lines, pa.int32())], ["chunk_id", "line_no"])


def _mapped(chunks: DataFrame, redact: bool, schema: str) -> DataFrame:
    chain = field()
    weights = chunks.sparkSession.sparkContext.broadcast((chain.emit, chain.step))  # 2 ** BITS rows, whatever the data
    rows = chunks.filter(F.col("id").isNotNull() & F.col("content").isNotNull()).select("id", "content")
    return spread(rows, "id").mapInArrow(lambda it: _run(it, weights, redact), schema)


def secret_lines(chunks: DataFrame) -> DataFrame:
    """(chunk_id, line_no) of every line on which a secret starts, once, however often the chunk was delivered.

    Null ids and contents are left out. Whole contents are read, whatever their length.
    """
    return _mapped(chunks, False, "chunk_id string, line_no int").distinct()


def redacted(chunks: DataFrame) -> DataFrame:
    """(chunk_id, content, secrets): each secret replaced by MASK, all other characters as they were; repeated rows stay repeated."""
    return _mapped(chunks, True, "chunk_id string, content string, secrets int")
