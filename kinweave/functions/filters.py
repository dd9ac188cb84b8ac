"""A postfix filter language over candidate rows, compiled to one boolean column.

Tokens are split at white space. An operator takes its operands from a stack, anything else is a literal. The
stack begins with the candidate's name. At the end one boolean is left, or two values that are compared. A text that
doesn't compile filters nothing, as documented for its users.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import inner_of, outer_of, package_of

BOOLEAN = {"eq", "equals", "and", "or", "not", "startswith", "endswith", "contains"}
PAIRS: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda a, b: F.coalesce(a == b, F.lit(False)),
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
    "startswith": lambda a, b: F.startswith(a, b),
    "endswith": lambda a, b: F.endswith(a, b),
    "contains": lambda a, b: F.contains(a, b),
}
PAIRS["equals"] = PAIRS["eq"]
PARTS: dict[str, Callable[[Column], Column]] = {
    "class": lambda a: F.substring_index(a, "/", -1),
    "package": package_of,
    "inner": inner_of,
    "outer": lambda a: F.coalesce(outer_of(a), F.lit("")),
}


def compiled(text: str, columns: Mapping[str, Column], start: Column, ancestors: Column | None = None) -> Column:
    """Condition of a filter; ``columns`` are its named values; ``a`` and ``b``, if given there, are the source item and the candidate.

    ``ancestors`` are the names of all that the candidate can stand for, itself included: what ``instanceof`` asks of it.
    """
    try:
        stack: list[tuple[Column, bool]] = [(start, False)]
        for word in text.split():
            token = word.lower() if word.lower() in PAIRS or word.lower() in PARTS or word.lower() in ("not", "dup", "swap", "instanceof") else word
            if token in columns:
                stack.append((columns[token], False))
            elif token == "instanceof":
                (b, _), (a, _) = stack.pop(), stack.pop()
                if ancestors is None or not (a is start or a is columns.get("b")):
                    raise ValueError("instanceof is about the candidate, and needs its ancestors")
                stack.append((F.array_contains(ancestors, b), True))
            elif token in PARTS:
                a, a_is = stack.pop()
                if a_is:
                    raise ValueError(f"{token} needs a name")
                stack.append((PARTS[token](a), False))
            elif token in PAIRS:
                (b, b_is), (a, a_is) = stack.pop(), stack.pop()
                if token in ("and", "or") and not (a_is and b_is):
                    raise ValueError(f"{token} needs two conditions")
                stack.append((PAIRS[token](a, b), True))
            elif token == "not":
                a, a_is = stack.pop()
                if not a_is:
                    raise ValueError("not needs a condition")
                stack.append((~a, True))
            elif token == "dup":
                stack.append(stack[-1])
            elif token == "swap":
                stack[-1], stack[-2] = stack[-2], stack[-1]
            else:
                stack.append((F.lit(token.strip('"')), False))
        if len(stack) == 1 and stack[0][1]:
            return stack[0][0]
        if len(stack) == 2 and stack[0][1] == stack[1][1]:
            return PAIRS["eq"](stack[0][0], stack[1][0])
        raise ValueError("a filter leaves one condition or two values")
    except (IndexError, ValueError):
        return F.lit(True)
