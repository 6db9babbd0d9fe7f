"""Limits and defaults of the search engine."""

BM25_K1 = 1.2
BM25_B = 0.75
DEFAULT_LIMIT = 10
MAX_LIMIT = 1000
MAX_QUERY_CHARS = 2048
DEFAULT_THREADS = 4
MAX_THREADS = 64
MERGE_FACTOR = 10
SEGMENT_MAX_DOCS = 10_000
SEGMENT_MAX_BYTES = 64 << 20
SKIP_INTERVAL = 128
SNIPPET_CONTEXT = 80
MAX_SNIPPETS = 3
QUERY_FIELDS = ("path", "ext", "size", "mtime", "type", "filename", "name")

STOP_WORDS = frozenset(
    """a all also an and are as at be been but by can could did do does for from had has have if in into is it its just
    may might no not of on or out should so that the this to up very was were which will with would""".split()
)

CODE_EXTENSIONS = tuple("bash c cpp cs dart go groovy h hpp java js kotlin kt lua matlab perl php ps1 py r rb rs scala sh sql swift ts vim zsh".split())
CONFIG_EXTENSIONS = tuple("cfg cmake conf dockerfile env gitignore gradle ini json maven properties toml xml yaml yml".split())
DOC_EXTENSIONS = tuple("adoc doc docx htm html md org pdf rst txt wiki".split())
DATA_EXTENSIONS = tuple("csv db parquet sqlite tsv xls xlsx".split())
#: Document formats that hold no plain text and are not collected.
BINARY_EXTENSIONS = tuple("db doc docx parquet pdf sqlite xls xlsx".split())
