"""Column functions on mail text: addresses, subjects, bodies, ids, secrets, lengths in tokens."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ends of lines, and white space, as Python's str has them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
SPACES = r"\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = rf"[{SPACES}]"

#: Reply and forward prefixes of subjects.
SUBJECT_PREFIX = rf"^(?:(?:re|fwd|fw|aw|ant)[:\[\]{SPACES}]+)+"

#: Lines from which on a body is a signature or a quoted message.
HARD_CUT = (
    rf"^(?:-- $|(?iu:-{{2,}}{SPACE}*(?:Original|Forwarded) message{SPACE}*-{{2,}}{SPACE}*$|Begin forwarded message:{SPACE}*$)"
    rf"|On(?![\p{{L}}\p{{N}}_])(?:.*[^\p{{L}}\p{{N}}_])wrote:{SPACE}*$)"
)

#: What secrets look like, and what stands for them; a first group stays.  Last, signs of which a text with such a
#: secret has one, in lower case: texts without them are not searched.
SECRETS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    (r"sk-ant-[A-Za-z0-9_-]+", "[REDACTED]", ("sk-ant-",)),
    (r"((?i:x-api-key)['\":=\s]+)[^\s,'\"}]+", "$1[REDACTED]", ("x-api-key",)),
    (r"((?i:authorization)['\":=\s]+(?i:bearer)\s+)[^\s,'\"}]+", "$1[REDACTED]", ("authorization",)),
    (r"AKIA[0-9A-Z]{16}", "[key]", ("akia",)),
    (r"gh[pousr]_[A-Za-z0-9]{20,}", "[token]", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    (r"sk-[A-Za-z0-9_-]{16,}", "[key]", ("sk-",)),
    (r"[Bb]earer [A-Za-z0-9._~+/=-]{8,}", "Bearer [token]", ("bearer ",)),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "[email]", ("@",)),
    (r"(?i:password|passwd|secret|api_key|token)\s*[=:]\s*[^\s,;]+", "[secret]", ("password", "passwd", "secret", "api_key", "token")),
)

#: An address is sought from the start of its run of letters, or from where the one before ended, not from each letter anew.
RUN_START = r"(?:\G|(?<![A-Za-z0-9._%+-]))"


def trimmed(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def _uncommented(address: Column) -> Column:
    """A header's address without comments in parentheses, nested ones once."""
    inner = F.regexp_replace(address, r"\([^()]*\)", "")
    return trimmed(F.regexp_replace(inner, r"\([^()]*\)", ""))


def canonical_addr(address: Column) -> Column:
    """Lower-case address of ``Name <a@b>``, ``a@b`` or ``a@b (Name)``; of a list the first; "" where there is no @."""
    plain = _uncommented(address)
    inner = F.regexp_extract(plain, r"(?s)^.*<([^<>]*)>", 1)
    bare = F.lower(trimmed(F.when(plain.rlike(r"<[^<>]*>"), inner).otherwise(F.split(plain, "[,;]", 2)[0])))
    return F.when(bare.contains("@"), bare).otherwise(F.lit(""))


def display_name(address: Column) -> Column:
    """Name of ``Name <a@b>`` without quotes, or of ``a@b (Name)``, or ""."""
    named = F.regexp_extract(_uncommented(address), r"(?s)^(.*)<[^<>]*>", 1)
    comment = F.when(~address.rlike(r"<[^<>]*>"), F.regexp_extract(address, r"\(([^()]*)\)", 1)).otherwise(F.lit(""))
    return trimmed(F.regexp_replace(F.when(trimmed(named) != "", named).otherwise(comment), '"', ""))


def normalize_subject(subject: Column) -> Column:
    """Lower case, without reply and forward prefixes, white space squeezed."""
    bare = F.regexp_replace(trimmed(F.lower(subject)), SUBJECT_PREFIX, "")
    return trimmed(F.regexp_replace(bare, rf"{SPACE}+", " "))


def normalize_body(body: Column) -> Column:
    """Line ends as \\n, runs of blank lines as one, none at the ends."""
    lines = F.regexp_replace(body, r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def strip_quotes(body: Column) -> Column:
    """Body without quoted lines and all from the first hard marker on; the body itself if nothing is left."""
    lines = F.split(body, LINE_END, -1)
    cuts = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(HARD_CUT), i)), lambda i: i.isNotNull())
    end = F.coalesce(F.array_min(cuts), F.size(lines))
    kept = F.filter(F.slice(lines, F.lit(1), end), lambda x: ~x.rlike(rf"^{SPACE}*>"))
    text = F.regexp_replace(F.array_join(kept, "\n"), rf"^{SPACE}+|{SPACE}+$", "")
    return F.when(F.length(text) > 0, text).otherwise(body)


def chunk_id(key: Column, index: Column, text: Column) -> Column:
    """sha256 of key, index and text with zero bytes between."""
    return F.sha2(F.concat(key, F.chr(F.lit(0)), index.cast("string"), F.chr(F.lit(0)), text), 256)


def occurrence_id(message: Column, content: Column, filename: Column, slot: Column) -> Column:
    """sha256 of message, content hash, file name and slot with zero bytes between."""
    zero = F.chr(F.lit(0))
    return F.sha2(F.concat(message, zero, content, zero, filename, zero, slot.cast("string")), 256)


def _replacing(where: Column, pattern: str, mark: str):
    return lambda t: F.when(where, F.regexp_replace(t, pattern, mark)).otherwise(t)


def redact(text: Column, secrets: Sequence[str] = ()) -> Column:
    """Text with the caller's secrets, and what looks like secrets and addresses, replaced."""
    for secret in secrets:
        if secret:
            text = F.replace(text, F.lit(secret), F.lit("[REDACTED]"))
    low = F.lower(text)
    for pattern, mark, signs in SECRETS:
        marked = reduce(lambda a, b: a | b, [low.contains(sign) for sign in signs])
        sought = RUN_START + pattern if mark == "[email]" else pattern
        # the text so far is bound once: named twice in a plain expression, each pattern would double it
        text = F.get(F.transform(F.array(text), _replacing(marked, sought, mark)), 0)
    return text


def maildir_flags(path: Column) -> Column:
    """Letters after the last ``:2,`` of a file name."""
    return F.regexp_extract(path, r":2,([^:/]*)$", 1)


def is_trashed(path: Column) -> Column:
    """Whether a file name has the flag T."""
    return maildir_flags(path).contains("T")


def maildir_unique(path: Column) -> Column:
    """File name before its flags."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r":2,[^:]*$", "")


#: A token of the default counter, with the white space before it.
TOKEN = r"\s*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"


def estimate_tokens(text: Column) -> Column:
    """Runs of letters and digits, and single other signs."""
    return F.regexp_count(text, F.lit(TOKEN))


def truncate_to_tokens(text: Column, limit: int) -> Column:
    """Text up to the end of its ``limit``-th token."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.when(F.size(found) > limit, F.array_join(F.slice(found, 1, limit), "")).otherwise(text)
