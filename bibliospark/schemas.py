"""Table schemas and integrity rules of a research-paper corpus.

The rules are data: the operators in ``operators.integrity`` read them, so a
table's checks are stated once, here.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# The domains and the seed rows must equal those a user of the
# original store already has.
VENUE_TYPES = ("conference", "journal", "preprint")
PAPER_STATUSES = (
    "pending",
    "downloading",
    "downloaded",
    "extracting",
    "extracted",
    "embedding",
    "ready",
    "failed",
)
LOG_STAGES = ("download", "extract", "parse", "embed")
LOG_STATUSES = ("success", "failed")
DEFAULT_VENUES = (
    ("ISMIR", "conference", "https://ismir.net"),
    ("ICASSP", "conference", "https://ieeexplore.ieee.org"),
    ("INTERSPEECH", "conference", "https://www.interspeech.org"),
    ("DAFx", "conference", "https://www.dafx.de"),
    ("WASPAA", "conference", "https://www.waspaa.com"),
    ("arXiv", "preprint", "https://arxiv.org"),
    ("IEEE TASLP", "journal", "https://ieeexplore.ieee.org"),
)


_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "array<string>": T.ArrayType(T.StringType()),
    "array<bigint>": T.ArrayType(T.LongType()),
}


def _schema(columns: str) -> T.StructType:
    """Schema from "name type [not null], ..."; needs no running session."""
    fields = []
    for column in columns.split(", "):
        name, kind, *rest = column.split()
        fields.append(T.StructField(name, _TYPES[kind], nullable=not rest))
    return T.StructType(fields)


TABLES: dict[str, T.StructType] = {
    "venues": _schema(
        "id bigint not null, name string not null, type string not null, "
        "url string, created_at timestamp_ntz"
    ),
    "authors": _schema(
        "id bigint not null, name string not null, name_normalized string not null, "
        "affiliations array<string>, created_at timestamp_ntz"
    ),
    "papers": _schema(
        "id bigint not null, title string not null, abstract string, full_text string, "
        "venue_id bigint, year int, arxiv_id string, doi string, pdf_url string, "
        "pdf_path string, status string, citation_count bigint, embedding_model string, "
        "embedded_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "paper_authors": _schema(
        "paper_id bigint not null, author_id bigint not null, position int not null"
    ),
    "citations": _schema(
        "citing_paper_id bigint not null, cited_paper_id bigint not null, "
        "created_at timestamp_ntz"
    ),
    "conversations": _schema(
        "id bigint not null, title string, created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "queries": _schema(
        "id bigint not null, conversation_id bigint, query_text string not null, "
        "response_text string, retrieved_ids array<bigint>, model_used string, "
        "latency_ms int, created_at timestamp_ntz"
    ),
    "processing_log": _schema(
        "id bigint not null, paper_id bigint, stage string not null, "
        "status string not null, message string, created_at timestamp_ntz"
    ),
}

PAPER_COLS = TABLES["papers"].fieldNames()


@dataclass(frozen=True)
class Rules:
    """What a row must satisfy to enter a table.

    ``required`` columns may not be NULL, ``domains`` limit a column to listed
    values (NULL passes), ``unique`` lists keys in the order they are reported
    and ``references`` maps a column to the table whose ``id`` it must name
    (NULL passes). ``defaults`` fill only columns that a batch does not have.
    """

    required: tuple[str, ...] = ()
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()
    references: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)


RULES: dict[str, Rules] = {
    "venues": Rules(
        required=("name", "type"),
        domains={"type": VENUE_TYPES},
        unique=(("name",),),
        defaults={"type": "conference"},
    ),
    "authors": Rules(
        required=("name", "name_normalized"),
        unique=(("name_normalized",),),
    ),
    "papers": Rules(
        required=("title",),
        domains={"status": PAPER_STATUSES},
        unique=(("arxiv_id",), ("doi",)),
        references={"venue_id": "venues"},
        defaults={"status": "pending", "citation_count": 0},
    ),
    "paper_authors": Rules(
        required=("paper_id", "author_id", "position"),
        unique=(("paper_id", "author_id"),),
        references={"paper_id": "papers", "author_id": "authors"},
    ),
    "citations": Rules(
        required=("citing_paper_id", "cited_paper_id"),
        unique=(("citing_paper_id", "cited_paper_id"),),
        references={"citing_paper_id": "papers", "cited_paper_id": "papers"},
    ),
    "conversations": Rules(),
    "queries": Rules(
        required=("query_text",),
        references={"conversation_id": "conversations"},
    ),
    "processing_log": Rules(
        required=("stage", "status"),
        domains={"stage": LOG_STAGES, "status": LOG_STATUSES},
        references={"paper_id": "papers"},
    ),
}


#: Unique columns by which single rows are read; a snapshot keeps bloom filters of them.
POINT_KEYS: dict[str, tuple[str, ...]] = {
    name: tuple(key[0] for key in rules.unique if len(key) == 1) for name, rules in RULES.items()
}

#: The columns by which a snapshot is range-sorted: what its keyed reads ask for.
LAYOUT: dict[str, tuple[str, ...]] = {
    "venues": ("id",),
    "authors": ("id",),
    "papers": ("id",),
    "paper_authors": ("paper_id", "author_id"),
    "citations": ("citing_paper_id", "cited_paper_id"),
    "conversations": ("id",),
    "queries": ("conversation_id", "id"),
    "processing_log": ("paper_id", "id"),
}
