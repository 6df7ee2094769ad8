"""Credentials in source text: candidates by trigram index, then the rules themselves.

One pass, no shuffle: a batch of texts is its own index segment. The bitmaps of the
trigrams that the rules require are intersected per rule; only the texts left are
decoded and searched.
"""

from __future__ import annotations

import base64
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm import trigrams
from codequarry.llm.textkernels import flat


class Rule(NamedTuple):
    name: str
    pattern: str  # group ``v`` is the credential
    weak: bool = False  # the value must look random


_QUOTED = r"""(?P<v>"[^"\n]*"(?:\s*\+\s*"[^"\n]*")*|'[^'\n]*'(?:\s*\+\s*'[^'\n]*')*|`[^`\n]*`)"""
_ASSIGN = r"""(?=["'\]\t :=])["'\]]?\s*(?::\s*[&*]?[A-Za-z][\w.<>\[\]]*\s*=|:=|=>|=(?!=)|:)\s*(?:[bru]|String::from\(|new String\()?"""
_STRONG_NAME = r"(?:passwords?|passwd|pwd|passphrase|passcode|secret|(?:user|login|db|admin|smtp|mail|root|ftp|ldap|account)[_-]?pass|(?:api|secret|signing|encryption|private|access|auth|master|deploy|account|storage|shared|client|service|license|admin|root|webhook)[_-]?key)"
_WEAK_NAME = r"(?:token|credentials?|creds?|bearer|pass|auth)"
_ACCOUNT = r"log ?in|sign ?in|account|user(?:name)?|admin|box|pass|credentials?|creds"

RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----(?:\s|\\[nr]|[#/*;-]|[\"'+])*(?P<v>[A-Za-z0-9+/=]{16,}(?:(?:\s|\\[nr]|[#/*;]|--(?!---)|[\"'+])+[A-Za-z0-9+/=]{4,})*)"),
    # Token formats as their providers document them.
    Rule("aws_key_id", r"(?<![A-Za-z0-9])(?P<v>(?:AKIA|ASIA)[0-9A-Z]{16})(?![A-Za-z0-9])"),
    Rule("github_token", r"(?<![A-Za-z0-9_])(?P<v>gh[opsur]_[A-Za-z0-9]{30,})"),
    Rule("github_fine_token", r"(?<![A-Za-z0-9_])(?P<v>github_pat_[A-Za-z0-9_]{30,})"),
    Rule("gitlab_token", r"(?<![A-Za-z0-9_])(?P<v>gl(?:pat|ptt|dt|rt|cbt|agent)-[A-Za-z0-9_-]{16,})"),
    Rule("slack_token", r"(?<![A-Za-z0-9_])(?P<v>xox[abeoprs]-[A-Za-z0-9-]{10,})"),
    Rule("slack_hook", r"hooks\.slack\.com/services/(?P<v>T[A-Z0-9]{6,}/B[A-Z0-9]{6,}/[A-Za-z0-9]{16,})"),
    Rule("secret_key_dash", r"(?<![A-Za-z0-9_])(?P<v>sk-(?:proj-|ant-|svcacct-)?[A-Za-z0-9_-]{20,})"),
    Rule("payment_key", r"(?<![A-Za-z0-9_])(?P<v>[rs]k_(?:live|test)_[A-Za-z0-9]{16,})"),
    Rule("google_key", r"(?<![A-Za-z0-9_])(?P<v>AIza[0-9A-Za-z_-]{30,})"),
    Rule("google_secret", r"(?<![A-Za-z0-9_])(?P<v>GOCSPX-[0-9A-Za-z_-]{20,})"),
    Rule("google_token", r"(?<![A-Za-z0-9_.])(?P<v>ya29\.[0-9A-Za-z_-]{30,})"),
    Rule("npm_token", r"(?<![A-Za-z0-9_])(?P<v>npm_[A-Za-z0-9]{30,})"),
    Rule("pypi_token", r"(?<![A-Za-z0-9_])(?P<v>pypi-[A-Za-z0-9_-]{30,})"),
    Rule("hub_token", r"(?<![A-Za-z0-9_])(?P<v>hf_[A-Za-z0-9]{30,})"),
    Rule("mail_key", r"(?<![A-Za-z0-9_.])(?P<v>SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,})"),
    Rule("bot_token", r"(?<![A-Za-z0-9_:])(?P<v>[0-9]{8,10}:AA[A-Za-z0-9_-]{32,34})(?![A-Za-z0-9_-])"),
    Rule("shop_token", r"(?<![A-Za-z0-9_])(?P<v>shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32})"),
    Rule("cloud_token", r"(?<![A-Za-z0-9_])(?P<v>(?:do[opr]_v1_[0-9a-f]{64}|dapi[0-9a-f]{32}|hv[sb]\.[A-Za-z0-9_-]{24,}|glsa_[A-Za-z0-9_]{32,}|lin_api_[A-Za-z0-9]{32,}|dp\.(?:pt|st|ct)\.[A-Za-z0-9]{40,}))"),
    Rule("age_key", r"(?P<v>AGE-SECRET-KEY-1[0-9A-Z]{50,})"),
    Rule("jwt", r"(?<![A-Za-z0-9_])(?P<v>eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{10,})"),
    Rule("url_password", r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"'<>]*:(?P<v>[^\s@\"'<>/]+)@[A-Za-z0-9\[]"),
    Rule("connection_password", r"(?i:(?<![A-Za-z0-9_-])(?:password|pwd|accountkey|sharedaccesskey)\s?=(?P<v>[^;\"'\s&,]{4,}))(?=;|[\"'])"),
    Rule("authorization", r"(?i:authorization[\"']?\s*[:,=]\s*[\"']?(?:bearer|basic|token)\s+(?P<v>[A-Za-z0-9._~+/=-]{8,}))"),
    Rule("key_header", r"(?i:x-(?:api|auth|access)-(?:key|token)[\"']?\s*[:,=]\s*[\"']?(?P<v>[A-Za-z0-9._~+/=-]{8,}))"),
    Rule("flag", r"(?i:--(?:[a-z]+[_-])?(?:password|passwd|passphrase|token|secret|api[_-]?key|access[_-]?key)=[\"']?(?P<v>[^\s\"']{6,}))"),
    Rule("flag_apart", r"(?i:--(?:[a-z]+[_-])?(?:password|passwd|passphrase|token|secret|api[_-]?key|access[_-]?key)\s+[\"']?(?P<v>[^\s\"'-][^\s\"']{11,}))", weak=True),
    Rule("named_value", rf"(?i:{_STRONG_NAME}{_ASSIGN}{_QUOTED})"),
    Rule("token_value", rf"(?i:{_WEAK_NAME}{_ASSIGN}{_QUOTED})", weak=True),
    Rule("element", rf"(?i:<[A-Za-z0-9_.-]{{0,60}}(?:{_STRONG_NAME}|{_WEAK_NAME}|_pw|-pw)>[ \t]*(?P<v>[^\s<>]{{4,}})[ \t]*</)"),
    Rule("element_pw", r"<[A-Za-z0-9_.-]{0,60}(?:[a-z0-9](?=Pw)|<(?=pw|PW)|_(?=PW))[pP][wW]>[ \t]*(?P<v>[^\s<>]{4,})[ \t]*</"),
    Rule("account_pair", rf"(?i:(?:{_ACCOUNT})\b[^\n\"'=]{{0,60}}[\s:(](?!https?:)[\w.@+-]{{2,40}}(?: [/|] | ?:(?!/)[ ]?)(?P<v>[^\s\"'/<>=,;]{{8,}})[)]?[ \t\r]*(?:$|\n|\*/|-->))"),
    Rule("pw_value", rf"(?:(?<=[a-z0-9_])Pw|(?<![A-Za-z])(?:pw|PW))[ :=\"'](?:[ \t]*[&*]?[A-Za-z][\w.<>]*[ \t]*=|[ \t]*(?::=|=>|=|:)?)[ \t]*{_QUOTED}"),
    Rule("pw_bare", r"(?:(?<=[a-z0-9_])Pw|(?<![A-Za-z])(?:pw|PW))[:=\"'][ \t:=]*(?P<v>[A-Za-z0-9+/_-]{8,}={0,2})[ \t]*(?:$|[\r\n},;])"),
    Rule("bare_value", rf"(?i:{_STRONG_NAME}(?=[\"'=:])[\"']?(?:=|:[ \t]+)(?P<v>[A-Za-z0-9+/_-]{{8,}}={{0,2}})[ \t]*(?:$|[\r\n}},;]))"),
    Rule("bare_token", rf"(?i:{_WEAK_NAME}(?=[\"'=:])[\"']?(?:=|:[ \t]+)(?P<v>[A-Za-z0-9+/_-]{{8,}}={{0,2}})[ \t]*(?:$|[\r\n}},;]))"),
    Rule("env_value", r"(?m:^[ \t]*(?:(?:export|set|ENV|ARG)[ \t]+)?[A-Z0-9_]*(?:PASSWORD|PASSWD|PASSPHRASE|PASS|PWD|SECRET|TOKEN|API_?KEY|ACCESS_KEY|PRIVATE_KEY|ENCRYPTION_KEY|SIGNING_KEY|CREDENTIALS?)=(?P<v>[^\s\"'`$<>(){}]{8,})[ \t\r]*$)", weak=True),
    Rule("setting_value", rf"(?im:^[ \t]*(?:-[ \t]+)?[\w.-]{{0,60}}{_STRONG_NAME}(?=[ \t]*[=:])(?:[ \t]*=|[ \t]*:[ \t])[ \t]*(?P<v>[^\s\"'`$<>(){{}}\[\],;]{{8,}})[ \t\r]*$)", weak=True),
)

#: Words that stand in for a credential.
STAND_INS = frozenset(
    "changeme change_me change-me replaceme replace_me replace-me todo fixme tbd example sample dummy placeholder none null nil undefined unset empty default "
    "test testing demo foo bar foobar secret password passwd token key apikey api_key redacted removed hidden masked not-needed not_needed notneeded unused "
    "n/a na no-key nokey ollama lm-studio lmstudio local localhost keyring keychain true false string xxx your-key".split()
)
_FILLERS = frozenset("a an and ci fake for here in insert it local me my no not of only or please put real replace set some the this to use user value with your api access auth client private service".split())
_REFERENCE = re.compile(
    r"^(?:\$|%[A-Za-z_][A-Za-z0-9_]*%$|\{\{|\{%|<|#\{|@|env[.:(\[]|vault[:.(]|file:|secrets?[./:(]|ssm:|arn:|keyring|keychain|op://|ref\+|process\.env|os\.(?:environ|getenv)|getenv|ENV[\[.]|System\.getenv|config[.\[(]|settings[.\[(]|!)"
)
_STAND_IN = re.compile(r"(?i:^(?:todo\b|fixme\b|tbd\b|(?:your|my|insert|enter|put|replace|change|example)[-_. ][^0-9]*$|(?:dummy|fake)[-_]|<.*>$|\[.*\]$|\(.*\)$|\{.*\}$))|x{8,}|(?:^|[-_])x{4,}$|\*{3,}|•{2,}|^\.{3}|\.{3}$|…|^AKIA[A-Z0-9]*EXAMPLE$|EXAMPLEKEY$")
#: A name that is called or indexed, and a name in braces: the value is made elsewhere.
_MADE_ELSEWHERE = re.compile(r"^[A-Za-z_$][\w$.:>-]*(?:\(.*\)|\[.*\]);?$|\{[A-Za-z_][\w.]*\}|%\([A-Za-z_]\w*\)s")
#: Words of a sentence, not of a passphrase.
_SENTENCE = frozenset(
    "a an and are at be by can for from has have in invalid is it key match must no not of on or password passwords please required reset secret show the this to token use was were will with wrong your "
    "bitte das der die ein eine falsch ist nicht passwort und de la le el los las es un une est mot passe contraseña del por para il lo di non è het een niet wachtwoord".split()
)
_NAME_BEFORE = re.compile(r"[\w.-]*$")
_NOT_A_SECRET_NAME = re.compile(r"(?i)(?:public|pub)[_-]?key$")


def is_literal_secret(value: str) -> bool:
    """A literal that opens something, not a stand-in, a mask or a reference."""
    v = value.strip().strip("\"'`").strip()
    if v.lower().startswith(("bearer ", "basic ", "token ")):
        v = v.split(None, 1)[1].strip()
    if not v or len(set(v)) < 3 or _REFERENCE.search(v) or _STAND_IN.search(v) or "${" in v or "{{" in v or "$(" in v:
        return False
    parts = [p for p in re.split(r"[\W_]+", v.lower()) if p]
    return v.lower() not in STAND_INS and not (parts and all(p in STAND_INS or p in _FILLERS or p.isdigit() and len(p) < 5 for p in parts))


def _passphrase(v: str) -> bool:
    """Several words: a passphrase has at least three and none of those that make a sentence."""
    words = v.lower().split()
    return len(words) == 1 or len(words) >= 3 and not any(w.strip(".,:;!?()") in _SENTENCE for w in words) and all(re.search(r"\w", w) for w in words)


def _looks_random(v: str) -> bool:
    kinds = bool(re.search("[a-z]", v)) + bool(re.search("[A-Z]", v)) + bool(re.search("[0-9]", v)) + bool(re.search(r"[^A-Za-z0-9_.\s-]", v))
    return len(v) >= 8 and kinds >= 2 and not re.fullmatch(r"[A-Za-z]+(?:[._-][A-Za-z]+)*", v) or (len(v) >= 20 and kinds >= 2)


def _dense(v: str) -> bool:
    """An unquoted setting: digits and letters with a sign or both cases, and no code or path in it."""
    return bool(re.search("[0-9]", v) and re.search("[A-Za-z]", v) and (re.search(r"[^\w.:/-]", v) or re.search("[a-z]", v) and re.search("[A-Z]", v))) and not re.search(r"^\w+(?:\.\w+)+$|::|->|/.*/", v)


def _encoded(v: str) -> bool:
    """An unquoted value: padded base64, base64 of a readable text, or long and mixed."""
    if len(v) % 4 == 0 and (len(v) >= 12 or re.search("[0-9=+/]", v)):  # few words of that length happen to decode
        try:
            plain = base64.b64decode(v, validate=True).decode("ascii")
            if len(plain) >= 5 and plain.isprintable():
                return True
        except ValueError:
            pass
    return len(v) >= 16 and bool(re.search("[0-9]", v)) and bool(re.search("[a-z]", v)) and bool(re.search("[A-Z]", v)) and "_" not in v


def _unquote(v: str) -> str:
    return "".join(re.findall(r"[\"'`]([^\"'`\n]*)[\"'`]", v)) if v[:1] in "\"'`" else v


#: Rules in which a name says that its value is a credential.
_NAMED = ("named_value", "token_value", "bare_value", "bare_token", "pw_value", "pw_bare", "element", "account_pair", "env_value", "setting_value")


def find(text: str, rules) -> list[tuple[int, int, str]]:
    """(start, end, rule) of every credential, without overlaps, by position."""
    hits = []
    for rule, pattern in rules:
        for m in pattern.finditer(text):
            raw = m["v"]
            value = _unquote(raw)
            if rule.name in _NAMED:
                if len(value) < 4 or _MADE_ELSEWHERE.search(value) or not (_passphrase(value) if rule.name in ("named_value", "pw_value") else not re.search(r"\s", value)):
                    continue
                if rule.name == "account_pair" and not re.search(r"[a-z][A-Z]|[0-9]|[^\w.-]", value):
                    continue
                name = _NAME_BEFORE.search(text, max(0, m.start() - 60), m.start())[0] + re.match(r"[\w.-]*", m[0].lstrip())[0]
                if _NOT_A_SECRET_NAME.search(name):
                    continue
            if rule.name in ("bare_value", "bare_token", "pw_bare") and not _encoded(value) or rule.name == "setting_value" and not _dense(value):
                continue
            if not is_literal_secret(value) or rule.weak and not _looks_random(value):
                continue
            s, e = m.span("v")
            hits.append((s, e, rule.name))
            if rule.name == "private_key":
                hits[-1] = (m.start(), e, rule.name)
    hits.sort(key=lambda h: (h[0], -h[1]))
    out: list[tuple[int, int, str]] = []
    for h in hits:
        if out and h[0] < out[-1][1]:
            if h[1] > out[-1][1]:
                out[-1] = (out[-1][0], h[1], out[-1][2])
            continue
        out.append(h)
    return out


def redact(text: str, hits) -> str:
    """The text with every credential's characters replaced by ``*``. Line ends,
    quotes, comment marks and escapes stay, so the code keeps its shape."""
    out, at = [], 0
    for s, e, rule in hits:
        part = text[s:e]
        if rule == "private_key":
            cut = part.index("KEY") + 3
            part = part[:cut] + re.sub(r"[A-Za-z0-9+/=]{4,}", lambda m: ("\\n" if m[0].startswith("\\n") else "") + "*" * len(m[0]), part[cut:].replace("\\n", "\x00")).replace("\x00", "\\n")
        elif part[:1] in "\"'`":
            part = re.sub(r"([\"'`])([^\"'`\n]*)\1", lambda m: m[1] + "*" * len(m[2]) + m[1], part)
        else:
            part = "*" * len(part)
        out += [text[at:s], part]
        at = e
    return "".join([*out, text[at:]])


def _scanner():
    schema = pa.schema(
        [("id", pa.string()), ("findings", pa.list_(pa.struct([("line_no", pa.int32()), ("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))), ("redacted", pa.string())]
    )
    state: dict = {}

    def run(batches):
        if not state:
            needs = [trigrams.required(r.pattern) for r in RULES]
            state["index"] = trigrams.Index(set().union(*map(trigrams.grams_of, needs)))
            state["rules"] = [(r, re.compile(r.pattern), n) for r, n in zip(RULES, needs)]
        index = state["index"]
        for batch in batches:
            data, off = flat(batch.column(1))
            bitmaps = index.postings(data, off)
            hit = np.stack([index.matching(n, bitmaps) for _, _, n in state["rules"]])
            rows = np.flatnonzero(hit.any(0))
            out: dict = {"id": [], "findings": [], "redacted": []}
            for i in rows:
                text = bytes(data[off[i] : off[i + 1]]).decode("utf-8", "replace")
                found = find(text, [(r, p) for (r, p, _), h in zip(state["rules"], hit[:, i]) if h])
                if found:
                    out["id"].append(batch.column(0)[int(i)].as_py())
                    out["findings"].append([{"line_no": text.count("\n", 0, s) + 1, "rule": r, "start": s, "end": e} for s, e, r in found])
                    out["redacted"].append(redact(text, found))
            if out["id"]:
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run, "id string, findings array<struct<line_no:int,rule:string,start:int,end:int>>, redacted string"


def credentials(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, findings, redacted)`` for every text that holds a credential.

    A finding has the line on which it begins (from 1, split at line feeds), the
    rule and its place in characters. Rows with a null id or text and empty texts
    give no row; repeated rows give repeated rows. Other columns are ignored.
    """
    run, schema = _scanner()
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null").mapInArrow(run, schema)


def literal_values(df: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """``(id, redacted)`` for every row whose value field itself is a credential:
    any literal but stand-ins, masks and references. Null and blank values are none.
    The field is the whole value, so there is nothing to look for and no index."""

    def run(batches):
        for batch in batches:
            ids, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = [(i, re.sub(r"[^\s\"'`]", "*", v)) for i, v in zip(ids, values) if is_literal_secret(v)]
            yield pa.RecordBatch.from_arrays([pa.array([k[j] for k in keep], pa.string()) for j in (0, 1)], names=["id", "redacted"])

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(value_col).cast("string").alias("value")).where("id is not null and value is not null")
    return rows.mapInArrow(run, "id string, redacted string")
