"""Plain forms that the tests compare with."""

import re


def words(text):
    """Words between ASCII white space, with A-Z in lower case."""
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
