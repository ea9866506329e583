"""Problem 3: credentials in source, configuration and documentation, by entropy and context."""

from __future__ import annotations

import base64
import binascii
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CODE_EXTENSIONS, map_rows, record_text

#: What stands for a masked credential.
MASK = "REDACTED"
#: Least part of the entropy a random string of the same length and alphabet could have.
RANDOM, CHOSEN = 0.78, 0.62
#: The same part without a name, and how long on average its runs of one kind of character may be.
NAMELESS, RUN = 0.85, 2.6
#: Prefixes by which issuers mark their tokens.
_ISSUED = re.compile(
    r"(?<![A-Za-z0-9+/_\-])(?:"
    r"(?:AKIA|ASIA)[A-Z0-9]{16}|AIza[\w\-]{30,}+|gh[pousr]_[A-Za-z0-9]{20,}+|github_pat_\w{22,}+|glpat-[\w\-]{18,}+"
    r"|xox[abprs]-[A-Za-z0-9\-]{16,}+|eyJ[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]{10,}|(?:sk|rk|pk)_(?:live|prod)_[A-Za-z0-9]{16,}+"
    r"|npm_[A-Za-z0-9]{30,}|pypi-[\w\-]{40,}|SG\.[\w\-]{16,}\.[\w\-]{16,}|sk-[A-Za-z0-9_\-]{24,}|hf_[A-Za-z0-9]{24,}|dop_v1_[a-f0-9]{64}|ya29\.[\w\-]{20,}"
    r")(?![A-Za-z0-9+/_=])"
)
_ADDRESS = re.compile(r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.\-]{1,30}://(?P<u>[^\s:@/\"'`<>]*+):(?P<v>[^\s@/\"'`]{3,}+)@[A-Za-z0-9\[]")
_HEADER = re.compile(r"(?i)\b(?P<k>basic|bearer|token|apikey)[ \t]+(?P<v>[A-Za-z0-9+/_=.\-]{8,}+)")
#: A sentence that tells an account with its password: a word for signing in, a linking word, name / password.
_LOGIN = re.compile(
    r"(?i)\b(?:log[ -]?ins?|sign[ -]?in|credentials|accounts?|zugang|zugangsdaten|anmeldung|anmelden|identifiants?|connexion|compte|acceso|credenciales|cuenta|usuario|acesso|credenciais|conta)\b[^\n/]*?(?:\b(?:is|are|as|with|using|ist|sind|lautet|lauten|mit|als|est|sont|avec|es|son|con|é|são|com)\b|[:=])[ \t]+[\"'`]?[\w.@\-]+[\"'`]?[ \t]*/[ \t]*[\"'`]?(?P<v>[^\s\"'`/]{6,}+)"
)
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----")
_PRIVATE_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----.*?(?:-----END|\Z)", re.S)
#: A line of a private key without its END mark: digits in base 64, quotes and glue around them, or a header.
_KEY_LINE = re.compile(r"[^\S\n]*(?:[>#*/+\"'`]++[^\S\n]*+)*+(?:(?:Proc-Type|DEK-Info|Version|Comment):[^\n]*|(?:\\[rn]|[A-Za-z0-9+/])*+=*(?:\\[rn])*)[\"'`+;,)\\\s]*?(?:\n|\Z)")
#: Words that name a password, and words that name a key or token.
_PASSWORDS = frozenset("password passwd passphrase passcode pwd pass passwort kennwort passe contrasena contraseña clave senha palavra parola wachtwoord".split())
_TOKENS = frozenset("secret secrets token tokens apikey key keys jwt pat bot hmac live auth authorization authentication credential credentials bearer signing accesskey secretkey authtoken".split())
#: Words beside which a name means no credential of its own.
_HARMLESS = frozenset("public pub field name names header label hint prompt column param parameter path file ref reference placeholder length min max policy regex pattern expiry ttl count type index primary foreign sort cache partition idempotency request trace commit sha sha1 sha256 sha512 md5 digest checksum hash fingerprint integrity etag icon image uuid version url uri endpoint".split())
_NAME = re.compile(
    r"(?P<n>(?i:pass|pwd|kennwort|contrase|clave|senha|palavra|parola|wachtwoord|secret|token|key|jwt|pat(?![a-z])|bot(?![a-z])|hmac|live|auth|credential|bearer)[\w$\-]*+)"
    r"[\"'`\])]{0,3}[ \t]*(?::[ \t]*[A-Za-z_][\w.<>\[\]|]*[ \t]*(?==[^=])|(?:\[[ \t]*\d*[ \t]*\])[ \t]*)?(?P<o>:=|=>|==|!=|=|:|[(,](?=\s*[rRbBuUfFL@]{0,2}[\"'`])|[ \t]+(?=[\"'`]))[ \t]*(?:\([ \t]*)?(?:\r?\n[ \t]*)?"
    r"(?:[rRbBuUfFL@]{0,2}(?:\"(?P<d>(?:[^\"\\\n]|\\.){4,}+)\"|'(?P<s>(?:[^'\\\n]|\\.){4,}+)'|`(?P<t>[^`\n]{4,}+)`)|(?P<r>[^\s\"'`,;(){}\[\]<>]{6,}+))",
)
_GLUE = re.compile(r"([\"'`])[ \t]*(?:\+[ \t]*(?:\\?\r?\n[ \t]*)?|\\?\r?\n[ \t]*(?:\+[ \t]*)?|[ \t]+)[rRbBuU]?\1(?=[^\"'`\s,;:)\]}])")
_STAND_IN = re.compile(
    r"(?i)[<>{}$%]\w*\b.*[<>})]|\$\{|\{\{|^\$\w+$|^%|<[^>]*>|^\(|\.\.\.|\*{3,}|x{4,}|0{6,}|1234567890|redacted|placeholder|example|change[-_]?me|insert|your[-_]|^(?:vault|env|file|ssm|arn|secret|kms|op|ref):|process\.env|environ"
)
_PLACEHOLDER = re.compile(
    r"(?i)(?:^|[^a-z])(?:your|my|some|the|insert|enter|replace|change|sample|dummy|fake|mock|removed|masked|hidden|todo|tbd|null|none|undefined|here|goes|test|foo|bar|lorem|env|environ|process|vault|getenv|config|settings)(?:[^a-z]|$)|^(?:password|passwort|passwd|secret|token|changeit|letmein|admin|root|user|guest|pass|pw|pwd)\d{0,4}$"
)
#: Words of calls whose argument is the name of what they give.
_GETTERS = frozenset("get fetch read load lookup find env getenv has is delete remove".split())
#: Words that, as the nearest before a nameless value, say that it is something else.
_OTHER = frozenset("id ids nonce salt build session revision rev cursor boundary seed cert certificate ssh rsa dss ed25519 ecdsa crc img svg png jpg jpeg gif font blob image avatar logo signature sig sprite".split())
_LITERAL = re.compile(r"([\"'`])(?P<v>[\w+/\-.~!@#^*$]{20,}+={0,2})\1|(?<![\w+/\-.~@:\"'`$%&?])(?P<w>[\w+/\-]{20,}+={0,2})(?![\w+/=\-.~@:(\[$%&?])")
#: Marks of encoded images, fonts, documents and public keys.
_ENCODED = re.compile(r"iVBORw0KGgo|/9j/|R0lGOD|PHN2Zy|PD94bWw|UklGR|AAABAA|Qk[02]|JVBERi|d09G[RM]|UEsDB|H4sI|AAAA[BCE]3NzaC1|AAAAE2VjZHNh|MI[IGH][A-Za-z]")
_BLOCK = re.compile(r"-----BEGIN (?![A-Z0-9 ]*PRIVATE KEY)[^\n]*?-----.*?(?:-----END|\Z)", re.S)
_KINDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_WORDS = re.compile(r"[A-Z]?[a-zñ]+|[A-Z]+(?![a-z])|\d+")
_HEX = re.compile(r"(?:0x)?[0-9a-fA-F]+")
_UUID = re.compile(r"(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}")
_COMMENT = re.compile(r"(?://|#|/\*|^\s*\*|<!--|\"\"\"|''')")
#: Any of these, in lower case, stands on a line that holds a credential.
_TRIGGERS = "pass pwd kennwort contrase clave senha palavra parola wachtwoord secret token key jwt pat bot hmac live auth credential bearer basic akia asia aiza ghp_ gho_ ghu_ ghs_ ghr_ github_pat glpat xox eyj sk_ rk_ pk_ npm_ pypi- sg. sk- hf_ dop_v1 ya29 :// login log-in sign-in zugang anmeld identifiant connexion compte account acceso cuenta usuario acesso conta".split() + ["log in", "sign in"]


@cache
def _triggers() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for word in _TRIGGERS:
        automaton.add_word(word, word)
    automaton.make_automaton()
    return automaton


def _regions(text: str) -> list[tuple[int, int]]:
    """Runs of lines with a trigger, each with the line that follows."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out: list[list[int]] = []
    done = -1
    address = low.find("@")
    for at, word in _triggers().iter(low):
        if at < done:
            continue
        if word == "key" and low[at + 1 : at + 10].lstrip(" \t")[:1] not in tuple("=:\"'`_-](,)si0123456789") :
            continue
        if word == "://":
            if 0 <= address < at:
                address = low.find("@", at)
            if address < 0:
                continue
        if word in ("pat", "bot") and low[at + 1 : at + 2].isalpha():
            continue
        start = text.rfind("\n", 0, at) + 1
        end = text.find("\n", at)
        done = len(text) if end < 0 else end
        end = text.find("\n", done + 1) if end >= 0 else -1
        end = len(text) if end < 0 else end
        if out and start <= out[-1][1] + 1:
            out[-1][1] = end
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def relative_entropy(value: str) -> float:
    """Entropy as a part of the most that its alphabet and length allow."""
    size = 16 if _HEX.fullmatch(value) else 64 if re.fullmatch(r"[A-Za-z0-9+/_=.\-]+", value) else 94
    return entropy(value) / math.log2(max(2, min(size, len(value))))


def is_random(value: str, least: int = 16) -> bool:
    """Looks issued by a machine: long, of several kinds of characters and of high entropy."""
    if len(value) < least or _STAND_IN.search(value) or _UUID.fullmatch(value) or re.search(r"\s", value):
        return False
    hexadecimal = _HEX.fullmatch(value)
    if hexadecimal and len(value) < 24 or re.fullmatch(r"[a-z]+(?:[_\-./:][a-z]+)*[_\-./:]?\d{0,4}", value) or re.match(r"(?:data:|https?:|sha\d+-)", value):
        return False
    part = relative_entropy(value)
    if len(value) < 24 and _PLACEHOLDER.search(value):
        return False
    if not re.search(r"[A-Za-z]", value):
        return False
    if not re.search(r"\d", value):
        return len(value) >= 20 and bool(re.search(r"[a-z][A-Z]|[A-Z]{3}", value)) and bool(re.search("[a-z]", value)) and part >= 0.85 and not re.fullmatch(r"(?:[A-Z]?[a-z]{3,}|[A-Z]+)(?:[_\-./]?[A-Z]?[a-z]{3,})*", value)
    return part >= RANDOM


def is_password(value: str, certain: bool = False) -> bool:
    """Looks chosen as a password: letters with digits or signs, and no placeholder.

    ``certain``: its place alone tells that it is one, so mixed case is enough.
    """
    if len(value) < 6 or re.search(r"\s", value) or _STAND_IN.search(value) or _PLACEHOLDER.search(value) or _UUID.fullmatch(value):
        return False
    if not re.search(r"[A-Za-z]", value) or value.count("/") > 1 and re.fullmatch(r"[\w\-./]+", value):
        return False
    if not re.search(r"\d|[?!#%&*+^~]", value) and not (certain and re.search(r"[a-z]", value) and re.search(r"[A-Z]", value)):
        return False
    return relative_entropy(value) >= CHOSEN


def _basic(value: str) -> bool:
    try:
        told = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return False
    user, colon, word = told.partition(":")
    return bool(colon) and len(word) >= 4 and not _STAND_IN.search(word) and not _PLACEHOLDER.search(word) and entropy(word) > 1.5


def _named(name: str, value: str, unquoted: bool, certain: bool) -> bool:
    words = [w.lower() for w in _WORDS.findall(name)]
    own = set(words)
    telling = own & _PASSWORDS, own & _TOKENS
    if not any(telling):
        joined = "".join(words)
        if re.search(r"passw(?:or[dt]|d)|apikey|secretkey|accesskey|authtoken|contrase", joined):
            telling = ({"password"}, set()) if re.search(r"passw|contrase", joined) else (set(), {"key"})
        else:
            return False
    if words and (own & _HARMLESS) and not ("header" in own and "auth" in own):
        return False
    if telling[0]:
        return is_password(value, certain)
    return is_random(value, 20 if unquoted else 16)


def credentials(text: str, extension: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the credentials' own characters, in order, without overlaps."""
    found: list[tuple[int, int, str]] = []
    for a, b in _regions(text):
        found.extend(_within(text, a, b, extension in CODE_EXTENSIONS))
    found.extend(_literals(text, extension in CODE_EXTENSIONS))
    found.sort(key=lambda x: (x[0], -x[1]))
    kept: list[tuple[int, int, str]] = []
    for x in found:
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
    return kept


def _glued(part: str) -> tuple[str, Callable[[int, int, bool], tuple[int, int]]]:
    """The text with literals in parts read as one, and a function from places in it to places in ``part``."""
    # taken[k] is how much was taken out before borders[k].
    borders, taken, out, at, total = [], [], [], 0, 0
    for m in _GLUE.finditer(part):
        out.append(part[at : m.start()])
        borders.append(m.start() - total)
        total += m.end() - m.start()
        taken.append(total)
        at = m.end()

    def spread(s: int, e: int, left: bool) -> tuple[int, int]:
        k, j = bisect_left(borders, s) if left else bisect_right(borders, s), bisect_left(borders, e)
        return s + (taken[k - 1] if k else 0), e + (taken[j - 1] if j else 0)

    return "".join([*out, part[at:]]) if borders else part, spread


def _nameless(value: str) -> bool:
    """Looks issued by a machine without a name to say so: no checksum, encoded file or public key."""
    if _HEX.fullmatch(value) or _ENCODED.match(value) or not re.search("[a-z]", value) or not re.search("[A-Z]", value) or not is_random(value, 20):
        return False
    runs = _KINDS.findall(value)
    return relative_entropy(value) >= NAMELESS and sum(map(len, runs)) <= RUN * len(runs)


def _named_otherwise(text: str, at: int) -> bool:
    """The last name before a place, on its line, is that of something else; what ends in secret or password is none."""
    k = at
    while k and not (text[k - 1].isalnum() or text[k - 1] == "\n"):
        k -= 1
    e = k
    while k and (text[k - 1].isalnum() or text[k - 1] in "_$-"):
        k -= 1
    words = [w.lower() for w in _WORDS.findall(text[k:e])]
    return bool(set(words) & (_HARMLESS | _OTHER)) and words[-1] not in ("secret", "password", "passwd", "passphrase")


def _argument(text: str, at: int, name: str) -> bool:
    """A name that is a whole literal, and no piece of encoded data."""
    runs = _KINDS.findall(name)
    return text[at - 1 : at] in ("'", '"', "`") and (len(name) < 20 or sum(map(len, runs)) > RUN * len(runs))


_BETWEEN = re.compile(r"[\"'`,;+.\\\s]*")


def _alone(text: str, found: list[re.Match]) -> Iterator[re.Match]:
    """The literals that aren't pieces of encoded data: three or more in a row, or two long ones of one length."""
    run: list[re.Match] = []
    for m in [*found, None]:
        if m and run and _BETWEEN.fullmatch(text, run[-1].end(), m.start()):
            run.append(m)
            continue
        if len(run) < 2 or len(run) == 2 and not (len(run[0][0]) == len(run[1][0]) >= 60):
            yield from run
        run = [m] if m else []


def _literals(text: str, code: bool) -> list[tuple[int, int, str]]:
    """Quoted strings and long tokens of the whole text that are random by themselves."""
    joined, spread = _glued(text)
    found: list[tuple[int, int, str]] = []
    blocks: list[tuple[int, int]] | None = None
    for m in _alone(joined, [*_LITERAL.finditer(joined)]):
        group = "v" if m["v"] is not None else "w"
        if not _nameless(m[group]) or _named_otherwise(joined, m.start(group)):
            continue
        if blocks is None:
            blocks = [x.span() for x in _BLOCK.finditer(joined)] + [x.span() for x in _PRIVATE_BLOCK.finditer(joined)]
        s, e = m.span(group)
        if any(a <= s < b for a, b in blocks):
            continue
        if joined[s - 7 : s] == "base64,":
            continue
        if group == "w":
            line = joined.rfind("\n", 0, s) + 1
            if code and not (joined[s - 1 : s] == "=" and joined[e : e + 1] in ("'", '"', "`")) and not _COMMENT.search(joined, line, s):
                continue
            # A line of nothing else beside another such line is part of an encoded file.
            if not joined[line:s].strip(" \t#*/") and _encoded_beside(joined, line, e):
                continue
        found.append((*spread(s, e, True), "literal"))
    return found


_FULL_LINE = re.compile(r"[ \t#*/]*[\w+/=\-]{20,}[ \t]*\r?$")


def _encoded_beside(text: str, line: int, end: int) -> bool:
    before = text[text.rfind("\n", 0, max(0, line - 1)) + 1 : max(0, line - 1)]
    after = text.find("\n", end)
    following = text[after + 1 : text.find("\n", after + 1) if text.find("\n", after + 1) >= 0 else len(text)] if after >= 0 else ""
    return bool(_FULL_LINE.match(before) or _FULL_LINE.match(following))


def _key_end(text: str, at: int) -> int:
    """Where a private key ends whose BEGIN mark ends at ``at``: at its END mark, or with its last line if there is none before the next BEGIN."""
    following = text.find("-----BEGIN", at)
    end = text.find("-----END", at, following if following >= 0 else len(text))
    if end >= 0:
        return end
    last = at
    while last < len(text) and (m := _KEY_LINE.match(text, last)) and m.end() > last:
        last = m.end()
    return last


def _within(text: str, begin: int, finish: int, code: bool) -> list[tuple[int, int, str]]:
    part = text[begin:finish]
    found: list[tuple[int, int, str]] = []
    for m in _PRIVATE.finditer(part):
        s = begin + m.start()
        end = _key_end(text, begin + m.end())
        body = re.sub(r"\\[rn]|[^A-Za-z0-9+/=]", "", text[begin + m.end() : end])
        if len(body) >= 40 and relative_entropy(body) >= RANDOM:
            found.append((s, end, "private key"))
    joined, spread = _glued(part)

    def add(s: int, e: int, kind: str) -> None:
        s, e = spread(s, e, kind == "named")
        found.append((begin + s, begin + e, kind))

    for m in _ADDRESS.finditer(joined):
        if is_password(m["v"], True) and not re.search(r"[{}$<>]", m["v"]):
            add(*m.span("v"), "address")
    for m in _LOGIN.finditer(joined):
        value = m["v"].rstrip(".,;:)")
        if is_password(value, True):
            add(m.start("v"), m.start("v") + len(value), "login")
    for m in _ISSUED.finditer(joined):
        if "EXAMPLE" not in m[0] and relative_entropy(m[0]) > 0.6 and not re.search(r"(?i)x{5,}|0{8,}|1234567890", m[0]):
            add(*m.span(), "issued token")
    for m in _HEADER.finditer(joined):
        kind, value = m["k"].lower(), m["v"]
        if kind == "basic" and _basic(value) or kind != "basic" and is_random(value):
            add(*m.span("v"), "header")
    line, stop, mark = 0, -1, -1
    for m in _NAME.finditer(joined):
        group = "d" if m["d"] is not None else "s" if m["s"] is not None else "t" if m["t"] is not None else "r"
        value, unquoted, certain = m[group], group == "r", False
        if m.start() > stop:
            line = joined.rfind("\n", 0, m.start()) + 1
            stop = joined.find("\n", m.start())
            stop = len(joined) if stop < 0 else stop
            mark = comment.end() if (comment := _COMMENT.search(joined, line, stop)) else len(joined) + 1
        k = m.start()
        while k > line and (joined[k - 1].isalnum() or joined[k - 1] in "_$-."):
            k -= 1
        before = joined[k : m.start()]
        if unquoted:
            j = k
            while j > line and joined[j - 1].isspace():
                j -= 1
            certain = j > line and joined[j - 1] == ";"
            if code and not certain and mark > m.start():
                continue
            value = value.rstrip(".,;:")
        if m["o"] == "(" and _GETTERS & {w.lower() for w in _WORDS.findall(before + m["n"])}:
            continue
        if m["o"] == "," and not _argument(joined, k, before + m["n"]):
            continue
        if _named(before + m["n"], value, unquoted, certain):
            s = m.start(group)
            add(s, s + len(value), "named")
    return found


def credential_lines(text: str, extension: str) -> list[int]:
    """Lines, counted from 1, on which a credential begins."""
    return sorted({text.count("\n", 0, s) + 1 for s, _, _ in credentials(text, extension)})


_BODY = re.compile(r"(\\[rn])|[A-Za-z0-9+/=]{2,}")


def masked(text: str, extension: str) -> str:
    """The text with MASK for each credential; quotes, glue and marks of private keys stay."""
    out, at = [], 0
    for s, e, kind in credentials(text, extension):
        out.append(text[at:s])
        piece = text[s:e]
        if kind == "private key":
            head = piece.index("KEY", 11) + 3
            head = piece.index("-----", head) + 5
            out.append(piece[:head] + _BODY.sub(lambda m: m[1] or MASK, piece[head:]))
        else:
            parts = [*_GLUE.finditer(piece)]
            inner = 0
            for m in parts:
                out.append(MASK if m.start() > inner else "")
                out.append(m[0])
                inner = m.end()
            out.append(MASK)
        at = e
    out.append(text[at:])
    return "".join(out)


def _texts(files: DataFrame) -> DataFrame:
    return files.filter("file_id IS NOT NULL").select("file_id", "extension", record_text().alias("text"))


def find_credentials(files: DataFrame) -> DataFrame:
    """(file_id, line_no) of each line on which a credential begins, in code and other records.

    Candidates are quoted strings and long tokens, judged by their entropy for alphabet
    and length, their name, issuer's prefix or place in an address or header. NULL and
    empty texts have none; a file_id delivered twice counts once; other columns are ignored.
    """

    def run(file_id, extension, text) -> Iterator[tuple]:
        return ((file_id, n) for n in credential_lines(text, extension))

    return map_rows(_texts(files).filter(F.col("text").isNotNull()), run, "file_id long, line_no int").distinct()


def mask_credentials(files: DataFrame) -> DataFrame:
    """(file_id, text) of every row, with the credentials masked and all else unchanged; NULL stays NULL."""
    return map_rows(_texts(files), lambda i, e, t: [(i, t if t is None else masked(t, e or ""))], "file_id long, text string")
