"""Fragments of the SQL side: the same text forms for an engine without them."""

WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def newlines(x: str) -> str:
    return f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def body_form(x: str) -> str:
    return strip(newlines(x))


def document_form(x: str) -> str:
    return f"(regexp_replace(nfc_normalize({newlines(x)}), '^[{WS}]+|[{WS}]+$', '', 'g') || chr(10))"


def ascii_width(x: str) -> str:
    """Full-width ASCII as ASCII: what NFKC does to ids that hold nothing else beyond ASCII."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    plain = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
    return f"translate({x}, '{wide}', '{plain}')"


def same_id(x: str) -> str:
    return f"nullif({strip(ascii_width(x))}, '')"
