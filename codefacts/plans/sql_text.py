"""Snippets of oracle SQL that several queries share."""

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NL = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def total_lines(col: str) -> str:
    return (
        f"(length({col}) - length(replace({col}, chr(10), '')) "
        f"+ case when {col} <> '' and right({col}, 1) <> chr(10) then 1 else 0 end)"
    )


def split_lines(col: str) -> str:
    return f"case when {col} = '' then [] else regexp_split_to_array(regexp_replace({col}, '(?:{NL})\\z', ''), '{NL}') end"


def code_lines(col: str) -> str:
    return f"len(list_filter(regexp_split_to_array({col}, '{NL}'), lambda x: not regexp_matches(x, '^{WS}*(#|//|$)')))"


def strip(col: str) -> str:
    return f"regexp_replace({col}, '^{WS}+|{WS}+$', '', 'g')"
