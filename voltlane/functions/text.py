"""Words, stems, credentials and redaction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic in a question to the team's documents.
STOPWORDS = """
a an the and or but if then else of to in on at by for with from into onto about over under as is are was were be been
being do does did done have has had having it its this that these those there here what which who whom whose where when
why how can could should would will shall may might must i me my we our us you your he she they them their not no yes
any all some each every more most less few many much very just also only so than too s t find show tell give get got
need want know please page pages doc docs document documents info information thing things about our team
""".split()
# Words that the team writes in several ways.
VARIANTS = {"freshman": ["freshmen", "frosh"], "freshmen": ["freshman", "frosh"], "frosh": ["freshman", "freshmen"], "elec": ["electrical"], "mech": ["mechanical"], "telem": ["telemetry"]}
# Fixed patterns: a credential is named, or may be named next to a value.
CREDENTIAL = r"(?i)\b(passwords?|passwd|passcodes?|passphrases?|pwd|api[\s_-]?keys?|secrets?|credentials?|ssh[\s_-]?keys?|private[\s_-]?keys?)\b"
MAYBE_CREDENTIAL = r"(?i)\b(log[\s-]?ins?|tokens?|pw|pwds?)\b"
# Fixed patterns: what keys look like, in the order in which they are looked for.
KEY_PATTERNS = [
    r"\b(?:ghp|gho|ghu|ghs|github_pat)_[A-Za-z0-9_]{20,}\b",
    r"\bsk-[A-Za-z0-9_-]{20,}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bxox[abpr]-[A-Za-z0-9-]{10,}\b",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|$)",
    r"(?<=://)[^/\s:@]+:[^/\s@]+(?=@)",
    r"(?i)(?<=[?&])(?:key|api_?key|token|access_token|auth|secret|client_secret|password|pass|pwd|sig|signature)=[^&#\s]+",
]
LONG_BLOB = r"(?<![A-Za-z0-9+_-])(?=[A-Za-z0-9+_-]*\d)(?=[A-Za-z0-9+_-]*[A-Za-z])[A-Za-z0-9+_-]{32,}={0,2}"
URL = r"https?://[^\s\"'<>\]\)]+"
REDACTED = "[redacted]"
WORD = r"[a-z0-9][a-z0-9._+-]*"
#: The same for letters and digits of all scripts.
ANY_WORD = r"[\p{L}\p{N}\p{M}][\p{L}\p{N}\p{M}._+-]*"


def words(text: Column, pattern: str = WORD) -> Column:
    """Lower-case words of two letters or more, without marks at their ends and without stop words; in order."""
    found = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0)), lambda w: F.rtrim(w, F.lit("._+-")))
    return F.filter(found, lambda w: (F.length(w) >= 2) & ~w.isin(*sorted(set(STOPWORDS))))


def stem(word: Column) -> Column:
    """Plurals and tenses folded roughly: the first of ing, es, ed, s that leaves more than three letters goes."""
    out = F.when(F.lit(False), word)
    for suffix in ("ing", "es", "ed", "s"):
        out = out.when((F.length(word) > len(suffix) + 3) & F.endswith(word, F.lit(suffix)), F.substring(word, F.lit(1), F.length(word) - len(suffix)))
    return out.otherwise(word)


def stems(text: Column) -> Column:
    return F.transform(words(text), stem)


def query_words(text: Column) -> Column:
    """A question's distinct words and their variants."""
    known = F.create_map(*[x for k, v in VARIANTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.flatten(F.transform(words(text), lambda w: F.concat(F.array(w), F.coalesce(F.element_at(known, w), F.array().cast("array<string>"))))))


def matches(text: Column, question: Column) -> Column:
    """Whether each word of the question, or a variant of it, is in the text, stem for stem; false for null text."""
    known = F.create_map(*[x for k, v in VARIANTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    need = F.transform(words(question), lambda w: F.transform(F.concat(F.array(w), F.coalesce(F.element_at(known, w), F.array().cast("array<string>"))), stem))
    have = stems(text)
    return F.coalesce(F.forall(need, lambda alternatives: F.arrays_overlap(alternatives, have)), F.lit(False))


def mentions_credential(text: Column, header: bool = False) -> Column:
    """A strong word, or a weak one with a value mark (in a table header the word is enough)."""
    t = F.coalesce(text, F.lit(""))
    weak = t.rlike(MAYBE_CREDENTIAL)
    return t.rlike(CREDENTIAL) | (weak if header else weak & t.rlike("[:=]"))


#: What every text has that holds a key: one quick look instead of a pass for each pattern.
KEY_HINT = r"gh[pous]_|github_pat_|sk-|AKIA|xox[abpr]-|-----BEGIN|://[^/\s:@]+:|[?&][A-Za-z_]+=|[A-Za-z0-9+_-]{32}"


def redact_keys(text: Column) -> Column:
    """The text with key-shaped strings replaced, and long mixed blobs too where they are outside URLs."""
    return F.when(text.rlike(KEY_HINT), _redacted(text)).otherwise(text)


def _redacted(text: Column) -> Column:
    for p in KEY_PATTERNS:
        text = F.regexp_replace(text, p, REDACTED)
    outside = F.transform(F.split(text, URL, -1), lambda part: F.regexp_replace(part, LONG_BLOB, REDACTED))
    urls = F.regexp_extract_all(text, F.lit(URL), F.lit(0))
    woven = F.zip_with(outside, urls, lambda part, url: F.concat(part, F.coalesce(url, F.lit(""))))
    return F.array_join(woven, "")
