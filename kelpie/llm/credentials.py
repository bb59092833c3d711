"""Credentials embedded in source code and configuration: find and redact.

Method: every string of a text is measured first; it is unnatural where the subwords of a
public tokenizer cover few characters each. Context rules then go over every line and decide
what an unnatural string, or a plain one in a place made for a password, means; what is left
is blanked character by character, so that all offsets stay. A line in ASCII without an
unnatural string and without any word that some rule requires is passed over: none matches it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm.tokenizers import FOLDER, chars_per_token, chars_per_tokens
from kelpie.session import spread

#: Characters for each subword below which a string is unnatural.
UNNATURAL = 3.0

# Public prefixes of issued tokens, and names of fields that hold a credential.
_ISSUED = re.compile(
    r"(?<![A-Za-z0-9_])(?:sk_live_[A-Za-z0-9]{16,}|rk_live_[A-Za-z0-9]{16,}|gh[opsu]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w-]{16,}"
    r"|xox[abprs]-[\w-]{16,}|npm_[A-Za-z0-9]{30,}|hvs\.[\w-]{16,}|AKIA[A-Z0-9]{16}|ASIA[A-Z0-9]{16}|AIza[\w-]{35}"
    r"|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})(?![A-Za-z0-9_])"
)
_SECRET_WORDS = frozenset("password passwd pwd pw pass passphrase pin secret token credential authorization auth authtoken passcode apikey secretkey pgpassword passwort senha contraseña hasło".split())
_KEY_OWNERS = frozenset("api shared account secret access signing private encryption storage master client subscription".split())
_PLACEHOLDER = re.compile(
    r"(?i)^(?:null|none|nil|true|false|undefined|empty|todo|tbd|n/?a|redacted|masked|hidden|secret|password|token|.*replace[-_ ]?me.*|.*change[-_ ]?me.*|.*placeholder.*|.*your[-_].*"
    r"|(.)\1*|dummy.*|example.*|\.\.\.+|strict|bearer|basic|required|optional|not[-_ ]set)$"
)
_REFERENCE = re.compile(r"^(?:\$|<|\{\{|%\(|%[A-Z_]+%|\*[a-z_\-]+$|&[a-z_\-]+$|!(?:Ref|Sub|GetAtt|ImportValue|vault|secret)\b|var\.|local\.|data\.|module\.|vault:|ref\+|arn:|secretsmanager|os\.|process\.|env\.|config\.|request\.|System\.|self\.)|\$\{|\$\(|\{\{|<\+|\$[A-Z_]{2,}|^[A-Za-z_][\w.]*\(.*\)$|^(?:prompt|getpass|input|file|lookup)\(")
_ASSIGN = re.compile(r"""(?<![\w.\-])(?P<key>[A-Za-z_][\w.\-]*+)["']?\s*+(?P<op>:=|=>|=|:)(?P<sp>\s*+)""")
_ASSIGNED = re.compile(r"""(?P<val>"(?:[^"\\\n]|\\.)*"|'(?:[^'\n])*'|[^\s,;"'`{}\[\]()|&]+)""")
_FIELD = re.compile(r"""(?i)\b(?P<key>pwd|password|sharedaccesskey|accountkey|sig|signature|_authtoken|pass|secret)=(?P<val>[^\s;&"'`<>,)]+)""")
_URL = re.compile(r"""(?<![a-z0-9+.\-])[a-z][a-z0-9+.\-]{1,30}://[^\s/:@"'`]*:(?P<val>[^\s/@"'`]+)@""")
_SCHEME = re.compile(r"""(?i)\b(?:bearer|basic)\s+(?P<val>[A-Za-z0-9+/=._\-~]{8,})""")
_USER = re.compile(r"""(?:\s-u|\s--user)[\s=]*["']?[\w.@\-]+:(?P<val>[^\s"']+)""")
_OPTION = re.compile(r"""--(?:password|passwd|token|secret|api-?key|pass|pin|passphrase|auth-token)(?:=|\s+)(?P<val>"[^"\n]*"|'[^'\n]*'|[^\s"'`|]+)""")
_SHORT_P = re.compile(r"""\b(?:mysql|mysqldump|mariadb)\b[^|\n]*?\s-p(?P<val>"[^"\n]*"|'[^'\n]*'|[^\s"']+)""")
_SPACED_P = re.compile(r"""\b(?:sshpass|docker\s+login|podman\s+login|helm\s+registry\s+login|\w+\s+login)\b[^|\n]*?\s-p\s*(?P<val>"[^"\n]*"|'[^'\n]*'|[^\s"']+)""")
_STDIN = re.compile(r"""\b(?:echo|printf)\s+(?:-n\s+)?(?P<val>"[^"\n]*"|'[^'\n]*'|[^\s"'|]+)\s*\|[^|\n]*--password-stdin""")
_PAIR = re.compile(r"""(?:\bauth\s*=\s*\(|\b\w*(?:Credentials?|BasicAuth\w*|Authentication)\()\s*["'][^"'\n]*["']\s*,\s*(?P<val>"[^"\n]*"|'[^'\n]*')""")
_CALL = re.compile(r"""(?i)\b(?:set)?(?:password|passwd|pwd|secret|token|apikey|passphrase|pin)\(\s*(?P<val>"[^"\n]*"|'[^'\n]*')\s*\)""")
_PGPASS = re.compile(r"""^\s*[\w.*\-]+:(?:\d+|\*):[^:\s]+:[^:\s]+:(?P<val>\S+)\s*$""")
_NETRC = re.compile(r"""(?:^|\s)(?:password|passwd)\s+(?P<val>[^\s"'`,;:=]{4,})\s*$""")
_PROSE = re.compile(
    r"""(?i)(?:\b(?:password|passwd|passphrase|passcode|pwd|pw|pin|token|api key|secret|passwort|kennwort|mot de passe|contraseña|senha|hasło|пароль|κωδικός)|パスワード)"""
    r"""(?:\s+(?:is|was|ist|est|es|é|to|still|lautet|jest)|\s*[:：=])?\s*(?:(?P<tick>[`"'])|[“„«(])?(?P<val>(?(tick)(?:(?!(?P=tick)).){4,}(?=(?P=tick))|[^\s`"'“”„«»,;|()]{6,}))"""
)
_LOGIN = re.compile(r"""(?i)\b(?:login|credentials?|account|user)\b[^:\n]{0,40}:\s*[\w.@\-]+\s*/\s*(?P<val>[^\s`"',;|()]{6,})""")
_PEM = re.compile(r"-----(?P<side>BEGIN|END) (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: Files that hold a private key and nothing else; a .pem does so only where its name says it.
_KEY_FILE = re.compile(r"(?i)(?:^|[/\\])(?:id_(?:rsa|dsa|ecdsa|ed25519|xmss)(?:_sk)?(?:[._-](?!pub\b)[^/\\]*)?|ssh_host_\w+_key|identity|(?![^/\\]*(?:pub|cert))(?:[^/\\]*\.(?:key|pk8|p8)|[^/\\]*(?:priv|key)[^/\\]*\.pem))$")
_CERT_FILE = re.compile(r"(?i)\.(?:crt|cer|pub)$|(?:pub|cert|chain)[^/\\]*\.(?:pem|key)$")
_KEY_LINES = re.compile(r"\s*(?:(?:Proc-Type|DEK-Info):[^\n]*\n\s*)*(?P<body>[A-Za-z0-9+/]+(?:[ \t]*\r?\n\s*[A-Za-z0-9+/]+)*={0,2})\s*")
_NAMED = re.compile(r"""["']?\bname["']?\s*[:=]\s*["']?(?P<name>[\w.\-]+)["']?""")
_VALUE = re.compile(r"""["']?\b(?:value|default)["']?\s*[:=]\s*(?P<val>"(?:[^"\\\n]|\\.)*"|'[^'\n]*'|[^\s,}"'#][^\s,}#]*)""")
_VARIABLE = re.compile(r"""^\s*variable\s+["'](?P<name>[\w\-]+)["']""")
_BLOCK = re.compile(r"""^(?P<pad>\s*)(?:-\s+)?["']?(?P<key>[A-Za-z_][\w.\-]*)["']?\s*[:=]\s*(?:[|>][+\-]?\d*|<<[-~]?["']?\w+["']?)\s*$""")
#: A string as the first step measures it, what of those looks made at random (letters of both cases and digits, not hexadecimal), and the key of an assignment or list right before one.
_STRING = re.compile(r"[A-Za-z0-9_+/.~\-]{12,}={0,2}")
_RANDOM = re.compile(r"(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z])(?=[^0-9]*[0-9])(?![0-9a-fA-F\-]+\Z)")
_KEYED = re.compile(r"""(?<![\w.\-])(?P<key>[A-Za-z_][\w.\-]*+)["']?\s*+(?::=|=>|=|:)\s*+(?P<list>[\[{(]\s*+)?""")
_ENDED = re.compile(r"[\"'\s,;\])}]|$")
_ITEM = re.compile(r"^\s*(?:-\s+)?(?P<quote>[\"']?)$")
_OPENED = re.compile(r"""^\s*(?:-\s+)?["']?(?P<key>[A-Za-z_][\w.\-]*)["']?\s*[:=]\s*[\[{(]?\s*$""")
# Words in the name of an unnatural string that make it a credential, and those that make it something else.
_TELLING = _SECRET_WORDS | frozenset("passwords secrets tokens credentials key keys private hmac cookie session jwt sas salt seed signing encryption master bearer webhook".split())
_OTHER = frozenset(
    "id ids uid uuid guid arn sha sha1 sha256 sha512 md5 hash hashes digest checksum sum integrity etag fingerprint thumbprint signature sig commit revision rev ref version tag image images public pub cert certs certificate"
    " certificates ca chain data content body icon logo font src href url uri path file filename template schema query cursor trace span request correlation container resource instance object pod node build release chart"
    " nonce iv name names host hostname endpoint type lock resolved".split()
)


@lru_cache(maxsize=65_536)
def _words(key: str) -> list[str]:
    return [w for w in re.split(r"[^0-9a-zà-ž]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", key).lower()) if w]


@lru_cache(maxsize=65_536)
def _holds_secret(key: str) -> bool:
    """Whether a field of this name holds a credential itself, not a name, policy or lifetime of one."""
    words = _words(key)
    if not words:
        return False
    if words[-1] == "key":
        return len(words) > 1 and words[-2] in _KEY_OWNERS or words[-2:] == ["x", "key"]
    if words[-2:] == ["key", "id"] or words[-2:] == ["access", "key"]:
        return True
    return words[-1] in _SECRET_WORDS


def _literal(value: str) -> str:
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def _plain(value: str) -> bool:
    """A literal that could grant access: no placeholder, variable or expression."""
    return len(value) >= 4 and not _PLACEHOLDER.match(value) and not _REFERENCE.search(value)


#: Rules of one line, and words of which each match in ASCII has one, in lower case; a search for them is cheaper than the rule.
_RULES = (
    (_URL, ("://",)), (_SCHEME, ("bearer", "basic")), (_USER, ("-u",)), (_OPTION, ("--pass", "--token", "--secret", "--api-key", "--apikey", "--pin", "--auth-token")), (_SHORT_P, ("mysql", "mariadb")), (_SPACED_P, ("sshpass", "login")), (_STDIN, ("--password-stdin",)), (_PAIR, ("auth", "credential")),
    (_CALL, ("pass", "pwd", "secret", "token", "apikey", "pin")), (_PGPASS, (":*:", *(f"{d}:" for d in "0123456789"))), (_FIELD, ("pwd", "pass", "key=", "sig=", "signature=", "_authtoken", "secret")),
)
_LOOSE_RULES = ((_PROSE, ("pass", "pwd", "pw", "pin", "token", "api key", "secret", "kennwort", "senha")), (_LOGIN, ("login", "credential", "account", "user")), (_NETRC, ("passw",)))
_ISSUERS = ("sk_live_", "rk_live_", "gh", "github_pat_", "glpat-", "xox", "npm_", "hvs.", "akia", "asia", "aiza", "eyj")
#: Parts of names, one of which each name in ASCII that holds a credential has.
_STEMS = ("pass", "pw", "pin", "secret", "token", "credential", "auth", "key", "senha")


def _shortest(words: set[str]) -> tuple[str, ...]:
    """The words without those that hold another one."""
    return tuple(sorted(w for w in words if not any(v in w for v in words - {w})))


#: What no rule can do without: a line in ASCII with none of these, in lower case, and no unnatural string shows no credential, and later lines look up in it what they need.
_WORDS = _shortest({w for _, words in (*_RULES, *_LOOSE_RULES) for w in words} | {*_ISSUERS, *_STEMS, "value", "default", "variable"})


class Finder:
    def __init__(self, folder: str = FOLDER, unnatural: float = UNNATURAL) -> None:
        self.folder, self.limit = folder, unnatural
        self.ratios: dict[str, float] = {}
        self.lines: dict[tuple[str, bool], list[tuple[int, int]]] = {}

    def measure(self, texts: list[str]) -> None:
        """Characters per subword of every distinct string of the texts, at once; what earlier texts had is forgotten."""
        strings = {s for t in texts for s in _STRING.findall(t)}
        self.ratios, self.lines = chars_per_tokens(strings, self.folder), {}

    def ratio(self, string: str) -> float:
        if (known := self.ratios.get(string)) is None:
            known = self.ratios[string] = chars_per_token(string, self.folder)
        return known

    def odd(self, line: str) -> list[re.Match]:
        """The unnatural strings of a line or text that look made at random: letters of both cases and digits, few characters for each subword."""
        known = self.ratios.get
        return [m for m in _STRING.finditer(line) if (known(m[0]) or self.ratio(m[0])) < 2.4 and _RANDOM.match(m[0])]

    def named(self, m: re.Match, line: str, key: str) -> bool:
        """Whether an unnatural string that is all of a value is a credential under this name."""
        words = set(_words(key))
        whole = m[0][0] not in "/.-" and "//" not in m[0] and _ENDED.match(line, m.end()) and not re.match(r"(?:sha\d+|ssh|ecdsa)-", m[0])
        return bool(whole) and not words & _OTHER and _plain(m[0]) and (bool(words & _TELLING) or len(m[0]) >= 20 and self.ratio(m[0]) < 2.2)

    def unnatural(self, value: str) -> bool:
        """Few characters for each subword, one word of many subwords, or words glued to digits as in made-up passwords."""
        core = value.strip(".,:!?*+")
        ratio = self.ratio(core)
        return ratio < self.limit or core.isalpha() and ratio * 4 <= len(core) and ratio < 4.5 or bool(re.search(r"[A-Za-z]-?\d{2,}[!?*+]?$", value) and re.search(r"[A-Z]", value))

    def in_line(self, line: str, code: bool) -> list[tuple[int, int]]:
        """Spans of credentials that the line shows by itself."""
        if (known := self.lines.get((line, code))) is None:
            known = self.lines[line, code] = self._in_line(line, code)
        return known

    def _in_line(self, line: str, code: bool) -> list[tuple[int, int]]:
        low = line.lower()
        every = not low.isascii()  # letters of other scripts fold in more ways
        spans = [m.span() for m in _ISSUED.finditer(line)] if every or any(w in low for w in _ISSUERS) else []
        for rule, words in _RULES:
            for w in words:
                if w in low:
                    break
            else:
                if not every:
                    continue
            for m in rule.finditer(line):
                raw = m["val"]
                if rule is _SCHEME and not self.unnatural(raw):
                    continue
                if rule is _FIELD and raw.startswith(("$", "{", "<", "%")):
                    continue
                if _plain(_literal(raw)):
                    spans.append(self._inner(m, raw))
        at = 0
        while (":" in line or "=" in line) and (m := _ASSIGN.search(line, at)):
            at = m.end()  # an assignment may lie within the value
            if not _holds_secret(m["key"]) or not (v := _ASSIGNED.match(line, at)):
                continue
            raw, value = v["val"], _literal(v["val"])
            at = v.end()
            if not _plain(value):
                continue
            quoted = raw != value
            if not quoted:
                if m["op"] == "=" and m["sp"]:  # an expression of a program or of Terraform
                    continue
                if code and m["op"] == "=" and not self.unnatural(value):
                    continue
                if m["op"] == ":" and not m["sp"] and not value[0].isalnum():
                    continue
                rest = line[v.end() :].strip()
                if rest and not rest.startswith(("#", "//", ",", "}", "&", "|", "(", "\\", "`", '"', "'", ";", "psql", "]", ")")) and m["op"] == ":" and not self.unnatural(value):
                    continue  # a sentence
                if value.startswith(("http://", "https://")):
                    continue
            if _words(m["key"])[-1] == "auth" and not self.unnatural(value):
                continue
            if _words(m["key"])[-1] == "authorization":
                continue  # the scheme's own rule has looked at it
            if value.lower().startswith(("-----begin", "ssh-")):
                continue
            spans.append(self._inner(v, raw))
        for rule, words in _LOOSE_RULES:
            for m in rule.finditer(line) if every or any(w in low for w in words) else ():
                value = m["val"].rstrip(".:")
                ticked = rule is _PROSE and m["tick"]
                if _plain(value) and (ticked or not re.search(r"^https?:|[/=<>{}]{2}|^--|[(\[{]", value) and not ("=" in value and _holds_secret(value.split("=")[0]))) and self.unnatural(value) and not re.search(r"\s", value):
                    if rule is _PROSE and _ASSIGN.match(line, m.start()) and not _holds_secret(_ASSIGN.match(line, m.start())["key"]):
                        continue
                    if rule is not _NETRC and value.islower() and value.isalpha() and not re.search(r"(?i)[:：=`]\s*[`\"']?$|\b(?:is|pw|pwd)\s+[`\"']?$|/\s*$", line[: m.start("val")]):
                        continue  # an ordinary word after the word
                    spans.append((m.start("val"), m.start("val") + len(value)))
        if odd := self.odd(line):
            spans += [m.span() for m, key in self._keyed(line, odd) if not any(a < m.end() and m.start() < b for a, b in spans) and self.named(m, line, key)]
        return spans

    @staticmethod
    def _keyed(line: str, strings: list[re.Match]) -> Iterator[tuple[re.Match, str]]:
        """The strings that are the value of a key of the line, or an item of a list that is, with the key."""
        openers = _KEYED.finditer(line)
        last, following, seen = None, next(openers, None), 0
        for m in strings:
            while following and following.end() <= m.start():
                last, seen, following = following, following.end(), next(openers, None)
            if not last:
                continue
            between = line[seen : m.start()]
            at_value = seen == last.end() and between in ("", '"', "'")
            if at_value or last["list"] and not any(c in between for c in "])}") and between.rstrip("\"'").rstrip()[-1:] == ",":
                yield m, last["key"]
                seen = m.end()

    @staticmethod
    def _inner(m: re.Match, raw: str) -> tuple[int, int]:
        cut = raw != _literal(raw)
        return m.start("val") + cut, m.end("val") - cut

    def find(self, text: str, path: str | None = None) -> list[tuple[int, int, int]]:
        """(line from 1, start, end) of each credential; offsets count code points."""
        code = bool(re.search(r"\.(?:tf|py|java|kt|go|js|ts|cs|rb)$", path or ""))
        found: list[tuple[int, int, int]] = []
        keys, skip = self._private_keys(text)
        if path and not keys and (_KEY_FILE.search(path) or _CERT_FILE.search(path)) and self._key_piece(text):
            return [(1, 0, len(text))] if _KEY_FILE.search(path) else []
        found += keys
        lines = text.split("\n")
        starts = list(accumulate((len(x) + 1 for x in lines[:-1]), initial=0))
        odd = {bisect_right(starts, m.start()) - 1 for m in self.odd(text)}
        skipped = bytearray(len(lines))
        for a, b in skip:
            self._mark(skipped, starts, a, b)
        variable, opened, seen = None, "", 0
        for i in sorted(odd | self._worded(text, lines, starts)):
            if skipped[i]:
                continue
            line, start, no = lines[i], starts[i], i + 1
            stop = start + len(line)
            if "variable" in line and (m := _VARIABLE.match(line)):
                variable = (m["name"], start) if _holds_secret(m["name"]) else None
            spans = list(self.in_line(line, code))
            if ("value" in line or "default" in line) and (v := _VALUE.search(line)):
                value = _literal(v["val"])
                n = _NAMED.search(line) or next((n for k in (i - 1, i - 2) if k >= 0 and not skipped[k] and "name" in lines[k] and (n := _NAMED.search(lines[k]))), None)
                inside = variable and text.find("\n}", variable[1], start) < 0 and variable[0]
                owner = (n and n["name"]) or inside
                comment = re.search(r"(?:#|//).*\b(?:token|password|secret|api key|passphrase)\b", line[v.end() :])
                if _plain(value) and (owner and _holds_secret(owner) or comment and self.unnatural(value)):
                    spans.append(self._inner(v, v["val"]))
            if i in odd and not spans:  # perhaps an item of a list under a telling name
                opened, seen = self._opened(lines, skipped, opened, seen, i), i
                if opened:
                    spans += [m.span() for m in self.odd(line)[:1] if _ITEM.match(line[: m.start()]) and self.named(m, line, opened)]
            found += [(no, start + s, start + e) for s, e in spans]
            b = _BLOCK.match(line) if "|" in line or ">" in line or "<<" in line else None
            if b and _holds_secret(b["key"]) and stop < len(text):
                self._mark(skipped, starts, stop + 1, self._block(text, stop + 1, no + 1, len(b["pad"]), found))
        return sorted(set(found))

    @staticmethod
    def _worded(text: str, lines: list[str], starts: list[int]) -> set[int]:
        """Lines, from 0, that hold a word some rule requires, and all that are not in ASCII."""
        low, found = text.lower(), set()
        if len(low) != len(text):
            return set(range(len(lines)))  # offsets differ in lower case
        if not text.isascii():
            found = {i for i, x in enumerate(lines) if not x.isascii()}
        for w in _WORDS:
            at = low.find(w)
            while at >= 0:
                i = bisect_right(starts, at)
                found.add(i - 1)
                at = low.find(w, starts[i]) if i < len(starts) else -1
        return found

    @staticmethod
    def _mark(skipped: bytearray, starts: list[int], a: int, b: int) -> None:
        """Lines that begin from a on and before b are not looked at any more."""
        first, last = bisect_left(starts, a), bisect_left(starts, b)
        skipped[first:last] = b"\1" * (last - first)

    @staticmethod
    def _opened(lines: list[str], skipped: bytearray, opened: str, seen: int, at: int) -> str:
        """The telling name whose list is open before a line, from what was open before an earlier one."""
        for i in range(seen, at):
            if not skipped[i]:
                line = lines[i]
                o = _OPENED.match(line) if line.rstrip()[-1:] in tuple(":=[{(") else None
                if o or opened and not re.match(r"\s*(?:-\s|[\"'\])}]|$)", line):
                    opened = o["key"] if o and _TELLING & set(_words(o["key"])) else ""
        return opened

    @staticmethod
    def _private_keys(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
        """Private keys with a line each, and the stretches they take up.

        A text that begins or ends within a key holds the part up to its END or from its BEGIN.
        """
        found, begun, ended = [], None, False
        for m in _PEM.finditer(text) if "PRIVATE KEY" in text else ():
            if m["side"] == "BEGIN":
                begun = m.start() if begun is None else begun
            else:
                if begun is not None or not ended:
                    found.append((begun or 0, m.end()))
                begun, ended = None, True
        if begun is not None:
            found.append((begun, len(text)))
        return [(text.count("\n", 0, a) + 1, a, b) for a, b in found], found

    def _key_piece(self, text: str) -> bool:
        """Whether a text is base64 lines only, as a piece of a key or certificate without its markers; the file's name tells which."""
        if not (m := _KEY_LINES.fullmatch(text)):
            return False
        body = re.sub(r"\s", "", m["body"])
        return len(body) >= 16 and bool(re.search("[A-Z]", body) and re.search("[a-z]", body) and re.search("[0-9+/]", body)) and self.ratio(body) < self.limit

    @staticmethod
    def _block(text: str, at: int, no: int, pad: int, found: list[tuple[int, int, int]]) -> int:
        """A value of several lines under a key: all of it, counted at its first line."""
        first = None
        while at < len(text):
            stop = text.find("\n", at)
            stop = len(text) if stop < 0 else stop
            body = text[at:stop]
            plain = body.strip()
            if not plain or len(body) - len(body.lstrip()) <= pad or plain.startswith("-----") or first is None and not _plain(plain):
                break
            first = first or no
            begin = at + body.index(plain)
            found.append((first, begin, begin + len(plain)))
            at, no = stop + 1, no + 1
        return at


_SPANS = "array<struct<line_no:int,start:int,stop:int>>"


def _scan(batches: Iterator[pd.DataFrame], folder: str, redact: bool) -> Iterator[pd.DataFrame]:
    finder = Finder(folder)
    for batch in batches:
        finder.measure([t for t in batch["_text"] if t])
        spans = [finder.find(t, p) if t else [] for t, p in zip(batch["_text"], batch["_path"])]
        out = batch.drop(columns=["_text", "_path"])
        if redact:
            out["_redacted"] = [_blank(t, s) if t is not None else None for t, s in zip(batch["_text"], spans)]
        out["_spans"] = [[{"line_no": a, "start": b, "stop": c} for a, b, c in s] for s in spans]
        yield out


def _blank(text: str, spans: list[tuple[int, int, int]]) -> str:
    if not spans:
        return text
    chars = list(text)
    for _, a, b in spans:
        chars[a:b] = [c if c in "\r\n" else "*" for c in chars[a:b]]
    return "".join(chars)


def credentials(df: DataFrame, text: str = "text", path: str = "file_path", keep: tuple[str, ...] = ("id",), redact: bool = False, folder: str = FOLDER) -> DataFrame:
    """The columns ``keep`` with ``_spans`` (line, start, stop of each credential) and, if asked for, ``_redacted``.

    One row for each input row; repeated rows stay. A null or empty text has no spans; a
    null text stays null when redacted. Every blanked character but line ends becomes
    ``*``, so all offsets and lines stay. Whole texts are read, whatever their length.
    A null path only leaves out what the file's kind would have told; a piece of a private
    key without BEGIN and END is told by that alone.
    """
    columns = [F.col(c) for c in keep]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    schema += (", _redacted string" if redact else "") + f", _spans {_SPANS}"
    return spread(df.select(*columns, F.col(text).alias("_text"), F.col(path).alias("_path"))).mapInPandas(lambda b: _scan(b, folder, redact), schema)
