"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import linededup, mixing, urlfilter, vectors, warc
from .decontaminate import op6_decontaminate
from .licenses import op9_licenses
from .linededup import op1_line_dedup
from .mixing import op10_mixing
from .quality import op3_quality
from .simhash import op7_simhash
from .toxicity import op4_toxicity
from .urlfilter import op8_url_filter
from .vectors import op5_vectors
from .warc import op2_warc

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_warc": op2_warc,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_vectors": op5_vectors,
    "op6_decontaminate": op6_decontaminate,
    "op7_simhash": op7_simhash,
    "op8_url_filter": op8_url_filter,
    "op9_licenses": op9_licenses,
    "op10_mixing": op10_mixing,
}
ORACLES: dict[str, str] = {
    "op1_line_dedup": linededup.ORACLE,
    "op2_warc": warc.ORACLE,
    "op5_vectors": vectors.ORACLE,
    "op8_url_filter": urlfilter.oracle(),
    "op10_mixing": mixing.oracle(),
}
