"""Bring rule patterns, written for Python's ``re``, to the JVM's regular expressions.

The two dialects agree on nearly everything a credential pattern uses. What differs and is
handled here: white space and digit classes are Unicode-aware, ignoring case folds all of
Unicode, ``$`` and ``.`` know only ``\\n``, ``\\Z`` is the very end, and ``[`` is an ordinary
character inside a class. A pattern this module cannot carry over exactly gets no JVM form;
its rule then runs on the Arrow path.
"""

import re
from dataclasses import dataclass

# The characters Python's ``\s`` matches, as the inside of a class.
SPACE_CHARS = (
    r"\t\n\x0B\f\r\x1C\x1D\x1E\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
)
DIGIT_CHARS = r"\p{Nd}"
WORD_CHARS = r"\p{L}\p{N}_"

_PIECE = re.compile(
    r"""(?P<cls>\[\^?\]?(?:\\.|[^\]\\])*\])
      | (?P<esc>\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|.))
      | (?P<open>\((?:\?(?:[ims]*(?:-[ims]+)?:|=|!|<=|<!|>|P<\w+>))?(?!\?))
      | (?P<close>\))
      | (?P<bar>\|)
      | (?P<many>(?:[*+?]|\{\d+(?:,\d*)?\}|\{,\d+\})[?+]?)
      | (?P<char>.)""",
    re.S | re.X,
)
_IN_CLASS = re.compile(r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|.)|.", re.S)
_BOUNDARY = {
    "b": f"(?:(?<=[{WORD_CHARS}])(?![{WORD_CHARS}])|(?<![{WORD_CHARS}])(?=[{WORD_CHARS}]))",
    "B": f"(?:(?<=[{WORD_CHARS}])(?=[{WORD_CHARS}])|(?<![{WORD_CHARS}])(?![{WORD_CHARS}]))",
}
_SHORTHAND = {"s": SPACE_CHARS, "d": DIGIT_CHARS, "w": WORD_CHARS}
# Escapes with one meaning in both dialects (plus every escaped punctuation character).
_SAME_ESCAPES = set("tnrfaAxu")


class NoJvmForm(ValueError):
    """The pattern uses something the two dialects read differently."""


@dataclass(frozen=True)
class JvmPattern:
    """A pattern as the JVM runs it.

    With a capture group the text before the group is captured too, as group 1, and the
    original group becomes group 2, so the group's offset is the match offset plus the length
    of group 1. Of several groups the first counts; the others only group.
    """

    regex: str
    grouped: bool
    literal: str  # text every match must start with; '' when there is none


def jvm_pattern(pattern: str) -> JvmPattern:
    """The JVM form of a Python pattern, or ``NoJvmForm``."""
    compiled = re.compile(pattern)
    if compiled.search(""):
        raise NoJvmForm("an empty match")
    flags = compiled.flags & ~re.UNICODE
    if flags & ~(re.IGNORECASE | re.DOTALL | re.MULTILINE):
        raise NoJvmForm("flags")
    body = re.sub(r"\A\(\?[ismu]+\)", "", pattern)

    out: list[str] = []
    depth = 0
    group_at = group_end = None
    literal, literal_open, something = "", True, False
    top_bar = asserts = False
    every = True
    pieces = list(_PIECE.finditer(body))
    for i, piece in enumerate(pieces):
        kind, text = piece.lastgroup, piece.group()
        following = pieces[i + 1] if i + 1 < len(pieces) else None
        optional = following is not None and following.lastgroup == "many" and (
            following.group()[0] in "*?" or following.group().startswith(("{0", "{,"))
        )
        repeated = following is not None and following.lastgroup == "many"
        if kind == "open":
            if text == "(" or text.startswith("(?P<"):
                if group_at is not None:
                    text = "(?:"
                elif depth:
                    raise NoJvmForm("nested capture group")
                else:
                    group_at, text = len(out), "("
            elif text.endswith(":"):
                text = text.replace("i", "iu")
            asserts |= text in ("(?=", "(?!", "(?<=", "(?<!")
            depth += 1
            literal_open = False
        elif kind == "close":
            depth -= 1
            if depth == 0 and group_at is not None and group_end is None:
                group_end = len(out)
                if repeated:
                    raise NoJvmForm("repeated capture group")
        elif kind == "bar":
            if depth == 0:
                top_bar, every = True, every and something
                something = False
            literal_open = False
        elif kind == "many":
            if text.startswith("{,"):
                text = "{0" + text[1:]
        elif kind == "cls":
            text = _class(text)
            literal_open = False
        elif kind == "esc":
            plain = not text[1].isalnum()
            if text[1] in "bB":
                if repeated:
                    raise NoJvmForm("repeated word boundary")
                asserts, text = True, _BOUNDARY[text[1]]
                out.append(text)
                continue
            text = _escape(text)
            literal_open &= plain and not repeated
            if literal_open:
                literal += text[1:]
        elif text in "()":
            raise NoJvmForm("group extension")
        else:
            literal_open &= text not in ".^$" and not repeated
            if literal_open:
                literal += text
            if text in "{}[]":
                text = "\\" + text
        if depth == 0 and kind in ("cls", "esc", "char") and not optional:
            something |= not (kind == "char" and text in "^$") and text not in (r"\A", r"\z")
        out.append(text)

    if asserts and not (every and something):
        raise NoJvmForm("may match the empty string")
    if flags & re.IGNORECASE or top_bar:
        literal = ""
    if group_at is not None:
        if top_bar:
            raise NoJvmForm("capture group in an alternative")
        head = "".join(out[:group_at])
        out = ["(", head, ")", *out[group_at:]]
    mode = "d" + "".join(
        letter
        for flag, letter in ((re.IGNORECASE, "iu"), (re.DOTALL, "s"), (re.MULTILINE, "m"))
        if flags & flag
    )
    return JvmPattern(f"(?{mode})" + "".join(out), group_at is not None, literal)


def _class(text: str) -> str:
    """A bracketed class; a nested ``[`` or ``&&`` means something else on the JVM."""
    lead = "[^" if text.startswith("[^") else "["
    parts = []
    for m in _IN_CLASS.finditer(text[len(lead) : -1]):
        c = m.group()
        if c.startswith("\\") and c[1] in _SHORTHAND:
            parts.append(_SHORTHAND[c[1]])
        elif c.startswith("\\"):
            parts.append(_escape(c))
        else:
            parts.append("\\" + c if c in "[]&^" else c)
    return lead + "".join(parts) + "]"


def _escape(text: str) -> str:
    c = text[1]
    if c in _SHORTHAND:
        return f"[{_SHORTHAND[c]}]"
    if c in "SDW":
        return f"[^{_SHORTHAND[c.lower()]}]"
    if c == "v":
        return r"\x0B"
    if c == "Z":
        return r"\z"
    if c in _SAME_ESCAPES or not c.isalnum():
        return text
    raise NoJvmForm(f"escape {text}")
