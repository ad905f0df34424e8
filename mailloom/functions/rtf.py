"""Plain text of RTF: a scanner over control words, groups and bytes."""

from __future__ import annotations

import re

from mailloom.functions.charsets import codec

#: Destinations, by subject, whose groups aren't text of the document.
_SUBJECTS = (
    # About the document.
    r"info|title|subject|author|manager|company|operator|category|keywords|comment|doccomm|hlinkbase|template|generator|docvar",
    r"(?:crea|rev|prin|bup)tim|userprops|propname|(?:static|link)val|password(?:hash)?|write(?:reservation|reservhash)|windowcaption|nextfile|private",
    # Tables of the header.
    r"(?:font|color|file|rev|rsid|xmlns|pgp|grid|protuser)tbl|fontemb|fontfile|panose|falt|fname|file|pgp|stylesheet|latentstyles|lsdlockedexcept",
    r"themedata|colorschememapping|datastore|def(?:chp|pap)|old[cpst]props",
    # Lists and numbers.
    r"list(?:table|overridetable|override|level|name|picture|stylename|text)?|level(?:text|numbers)|lfolevel|pn(?:seclvl|text|txta|txtb)?|[lf]chars",
    # Running heads, notes, remarks, marks and entries of indices.
    r"(?:header|footer)[flr]?|footnote|a?ftn(?:cn|sepc?)|annotation|atn(?:author|date|icn|id|parent|ref|time)|atrf(?:start|end)",
    r"(?:bkmk|prot)(?:start|end)|ebc(?:start|end)|[rtp]?xe|tc",
    # Fields and forms.
    r"fldinst|fldtype|formfield|datafield|ff(?:deftext|entrymcr|exitmcr|format|helptext|l|name|stattext)|xform|factoidname|keycode",
    # Pictures, shapes and objects.
    r"object|obj(?:alias|class|data|name|sect|time)|oleclsid|result|pict|picprop|blipuid|shp(?:grp|inst|pict|rslt|txt)?|s[pnv]|svb|background|do|dptxbxtext",
    r"hl(?:fr|loc|src)?|hsv|g|upr|ud|nesttableprops|nonesttables|wgrffmtfilter|m?htmltag|xml(?:attrname|attrvalue|close|name|open)",
    # Mail merging.
    r"mailmerge|mm(?:addfieldname|connectstr(?:data)?|datasource|headersource|mailsubject|query)",
    r"mmodso(?:filter|fldmpdata|mappedname|name|recipdata|sort|src|table|udl|udldata|uniquetag)?",
    # Formulas: elements, their properties, and the values of these.
    r"m(?:acc|bar|borderBox|box|d|eqArr|f|func|groupChr|limLow|limlow|limupp|m|nary|phant|r|rad|sPre|sSub|sSubSup|sSup)(?:Pr)?",
    r"m(?:mc|ctrl|marg|oMathPara)Pr|margPr|mm(?:ath|athPict|athPr|axdist|c|cJc|cs|r)|moMath(?:Para)?|mmath|mt(?:ransp|ype)|mv(?:ertJc|fmf|fml|tof|tol)",
    r"m(?:aln|alnScr|baseJc|begChr|endChr|sepChr|chr|count|deg|degHide|den|diff|e|fName|grow|lim|limloc|maxdist|noBreak|num|objDist|opEmu|plcHide|pos|show|shp)",
    r"mhide(?:Bot|Left|Right|Top)|mstrike(?:BLTR|H|TLBR|V)|msu[bp](?:Hide)?|mzero(?:Asc|Desc|Wid)",
)
_APART = re.compile("|".join(f"(?:{x})" for x in _SUBJECTS))
_WORDS = {"par": "\n", "line": "\n", "row": "\n", "sect": "\n\n", "page": "\n\n", "tab": "\t", "cell": "|", "nestcell": "|", "bullet": "•"}
_WORDS |= dict(zip("endash emdash lquote rquote ldblquote rdblquote enspace emspace qmspace".split(), "–—‘’“”   "))
_SIGNS = dict(zip("{}\\\n\r", "{}\\\n\r")) | {"~": " ", "-": "­", "_": "‑"}
_PLAIN = re.compile(r"[^\\{}\r\n]+")
_CONTROL = re.compile(r"([a-z]{1,32})(-?\d{1,10})? ?", re.I)
_HEX = re.compile(r"'([0-9a-f]{2})", re.I)
_TARGET = re.compile(r'HYPERLINK\s+(?:\\\\?\w+\s+)*("[^"]*")', re.I)


def rich_text(text: str, charset: str = "cp1252") -> str:
    """The plain text of RTF; groups of other content are left out, and the text of a link is followed by its quoted target in parentheses."""
    out: list[str] = []
    held = bytearray()
    # Of each open group: characters that stand for a \\u, whether it is left out, and the places where a field and an instruction begin.
    groups: list[tuple[int, bool, int, int]] = []
    spare, apart, skip, field, order, target = 1, False, 0, -1, -1, ""
    at, end = 0, len(text)
    while at < end:
        c = text[at]
        coded = _HEX.match(text, at + 1) if c == "\\" else None
        if held and not coded:
            out.append(held.decode(charset, "replace"))
            held.clear()
        if coded:
            at = coded.end()
            if skip:
                skip -= 1
            elif not apart:
                held.append(int(coded[1], 16))
        elif c == "{":
            groups.append((spare, apart, field, order))
            field = order = -1
            skip, at = 0, at + 1
        elif c == "}":
            if order >= 0 and (link := _TARGET.search(text, order, at)):
                target = link[1]
            if field >= 0 and target:
                out.append(f"({target})")
                target = ""
            spare, apart, field, order = groups.pop() if groups else (0, True, -1, -1)
            skip, at = 0, at + 1
        elif c in "\r\n":
            at += 1
        elif c != "\\":
            run = _PLAIN.match(text, at)
            at = run.end()
            if not apart:
                out.append(run[0][skip:])
            skip = max(0, skip - len(run[0]))
        elif word := _CONTROL.match(text, at + 1):
            at, skip = word.end(), 0
            name, number = word[1], word[2]
            if name == "field":
                field = at
            elif name == "fldinst":
                order = at
            if _APART.fullmatch(name):
                apart = True
            elif name == "ansicpg":
                charset = codec(f"cp{number}") or "utf-8"
            if apart:
                continue
            if name in _WORDS:
                out.append(_WORDS[name])
            elif name == "uc" and number:
                spare = int(number)
            elif name == "u":
                skip = spare
                if number:
                    out.append(chr(int(number) % 0x10000))
        else:
            sign = text[at + 1 : at + 2]
            at, skip = at + 2, 0
            if sign == "*":
                apart = True
            elif not apart:
                out.append(_SIGNS.get(sign, ""))
    return "".join(out) + held.decode(charset, "replace")
