"""Patterns of citations, identifiers, claim references and reference markup.

They are written so that Java's and RE2's engines agree: white space is an explicit
class, a text's end is ``\\z``, and only ASCII letters and digits are meant.
"""

# What counts as a citation, identifier or reference, and as white space.
SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NOT_SPACE = r"[^\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
SPACES = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
NAME = "[A-Z][a-z]+"
INLINE = rf"({NAME}(?:{SPACE}*(?:,|&|and){SPACE}*{NAME})*(?:{SPACE}+et{SPACE}+al\.)?){SPACE}*\((\d{{4}})\)"
AUTHOR_BREAK = "(?i)[,&]| and | et al"
CO_AUTHORS = "[,&]| and "
DOI = rf"(?i)(?:doi\.org/|doi:{SPACE}*)(10\.\d{{4,}}/{NOT_SPACE[:-1]},)]+)"
ARXIV = rf"(?i)arxiv(?::|{SPACE})*(\d{{4}}\.\d{{4,5}})"
FULL_REFERENCE = rf"(?m)^[-*]{SPACE}*(.+?){SPACE}*\((\d{{4}})\)\.{SPACE}*(.+?)(?:\.{SPACE}*\*?([^.]+?)\*?(?:,{SPACE}*(\d+))?)?\.?{SPACE}*$"
CLAIM_REFERENCE = r"\[(NB\d+(?:\.\d+)?):(K\d+)\]"
CATALOG_HEADING = rf"^##{SPACE}+(NB\d+(?:\.\d+)?)(?::|{SPACE})"
CATALOG_CLAIM = r"^\*{0,2}(K\d+)\*{0,2}$"
CLAIM_ROW = rf"\|{SPACE}*\*{{0,2}}K\d+\*{{0,2}}{SPACE}*\|"
BLOCK_HEADING = rf"^##{SPACE}*Key Claims"
NEXT_HEADING = rf"^##{SPACE}"
BLOCK_MARKER = "## Key Claims"
VERIFIED = rf"<!--{SPACE}*Verified:{SPACE}*(\d{{4}}-\d{{2}}-\d{{2}}){SPACE}*-->"
NOTEBOOK_NAME = r"^(\d+)(?:_(\d+))?"
REFERENCE_ITEM = r'<li[^>]*id="bib[^"]*"[^>]*>([\s\S]*?)</li>'
REFERENCE_DOI = rf'(?i)doi\.org/([^"<{NOT_SPACE[2:-1]}]+)'
REFERENCE_CITE = r'<cite[^>]*class="ltx_cite[^"]*"[^>]*>([^<]+)</cite>'
REFERENCE_ITALIC = r"<i[^>]*>([^<]{10,})</i>"
REFERENCE_TITLE = rf"\(\d{{4}}\){SPACE}*\.?{SPACE}*([^.]{{15,}}?)(?:\.{SPACE}|\z)"
REFERENCE_YEAR = r"\((\d{4})\)"
PREPRINT_DOI = "10.48550/"
PREPRINT_URL = r"arxiv\.org/abs/(\d{4}\.\d{4,5})"
ENTRY_ID = r"<id>http://arxiv\.org/abs/([^<]+)</id>"
ENTRY_TITLE = r"<title>([^<]+)</title>"
ENTRY_PUBLISHED = r"<published>([^<]+)</published>"
ENTRY_CATEGORY = r'<category[^>]*term="([^"]+)"'
ENTRY_NAME = r"<name>([^<]+)</name>"
