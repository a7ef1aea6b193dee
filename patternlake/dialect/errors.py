"""Pattern errors, raised on the driver before a plan exists."""

from __future__ import annotations

HINTS = {
    "UnmatchedParenthesis": "every '(' needs its ')'",
    "UnmatchedBracket": "every '[' needs its ']'",
    "InvalidQuantifier": "a quantifier needs something to repeat, and bounds in order",
    "InvalidEscapeSequence": "escape a backslash as '\\\\'",
    "InvalidCharacterClass": "check the class's ranges and names",
    "UnexpectedCharacter": "escape it to match it literally",
    "UnexpectedEndOfPattern": "the pattern stops inside a construct",
    "PatternTooComplex": "nested unbounded repeats can take exponential time",
    "NestingTooDeep": "use fewer nested groups",
    "InvalidBackreference": "the group it names does not exist",
    "DuplicateGroupName": "names may repeat in different alternatives only",
    "NotImplemented": "the construct has no equivalent here",
}


class PatternError(ValueError):
    """``code`` tells the kind, ``position`` the place in ``pattern``."""

    def __init__(self, code: str, pattern: str = "", position: int = 0, detail: str = "") -> None:
        self.code, self.pattern, self.position = code, pattern, position
        self.hint = HINTS.get(code, "")
        caret = f"\n  {pattern}\n  {' ' * position}^" if pattern else ""
        super().__init__(f"{code}{': ' + detail if detail else ''}{caret}{chr(10) + '  hint: ' + self.hint if self.hint else ''}")
