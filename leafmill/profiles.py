"""What differs between document families: a profile holds patterns and limits; all jobs take one."""

from __future__ import annotations

from dataclasses import dataclass, field

# Patterns, prefixes, word lists and limits which decide where documents are cut.
HEADER_PREFIXES = ("BASELINE IT SECURITY POLICY", "IT SECURITY GUIDELINES")
TOP = r"^(\d+)\.?\s+([A-Z][A-Z &,/\-]+)$"
SUBSECTION = r"^(\d+\.\d+)\.?\s+([A-Z].+)$"
CONTROL = r"^(\d+\.\d+\.\d+)\.?\s+(.+)$"
APPENDIX = r"^APPENDIX ([A-Z])\s+(.+)$"
LETTER = r"^\(([a-z])\)\s+(.+)$"
PAGE_LABEL = r"^Ref\.\s*No\.\s*:\s*(S17|G3)\s+(.+)$"
TOC_LEADER = r"\s*\.{2,}.*$"
ENUMERATED = r"(?i)^(?:[a-z]\)|\([a-z]\)|\d+\.)\s+"
BULLETS = "[•]"
BULLET = "•"
CONNECTORS = ("and", "of", "the", "in", "for", "to", "on", "with", "by", "&")
MODALS = ("shall", "should", "must", "will")
TARGET_WORDS = 220
HARD_MAX_WORDS = 300
HEADING_WORDS = 12


@dataclass(frozen=True)
class Profile:
    """Settings of one document family."""

    document: str = "S17"
    version: str = "8.2"
    language: str = "en"
    source_file: str = "documents"
    top: str = TOP
    subsection: str = SUBSECTION
    control: str = CONTROL
    appendix: bool = True
    lettered: bool = False
    guarded: bool = True  # control and subsection numbers must begin with the current top number
    header_prefixes: tuple[str, ...] = HEADER_PREFIXES
    header_lines: tuple[str, ...] = field(default=())  # whole lines dropped besides
    header_block: bool = True  # drop all that stands before the page label
    first_label: str | None = "1"  # printed page at which the body begins
    first_page: int | None = None  # or the physical page
    wrapped_titles: bool = True
    enumerated: str = ENUMERATED
    word_cut: bool = True  # cut sentences beyond the hard limit; else they are marked for review
    context_text: bool = True  # passages carry section and parents ahead of the text


STANDARD = Profile()
GUIDELINE = Profile(document="G3", version="10.2", lettered=True)
#: The older handler: numbers end in a dot, the body begins on physical page 7, nothing is guarded, joined or cut.
OLDER = Profile(
    top=r"^(\d+)\.\s+([A-Z][A-Z &,/\-]+)$",
    subsection=r"^(\d+\.\d+)\.\s+(.+)$",
    appendix=False,
    guarded=False,
    header_prefixes=HEADER_PREFIXES[:1],
    header_lines=("INFORMATION SECURITY",),
    header_block=False,
    first_label=None,
    first_page=7,
    wrapped_titles=False,
    enumerated=r"(?i)^[a-z]\)\s+",
    word_cut=False,
)
#: The experiment before that: bare piece text, without the context lines.
BARE = Profile(**{**OLDER.__dict__, "header_lines": (), "context_text": False})
