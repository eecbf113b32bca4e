"""Sources (FASTA, contact-map CSV, documents-derived alignments) and sinks."""

from copair.sources.documents import alignment_from_documents, load_table  # noqa: F401
from copair.sources.fasta import (  # noqa: F401
    pair_alignments,
    read_alignment,
    read_contact_map,
    write_result,
)
