"""Readers of the input formats."""
from .bed import bed_record_scan
from .fasta import contig_tiles, fasta_contig_scan, fasta_tile_scan
from .hits import hit_tsv_scan
from .pairs import pair_tsv_scan
from .regions import region_table_scan

__all__ = [
    "bed_record_scan", "contig_tiles", "fasta_contig_scan", "fasta_tile_scan", "hit_tsv_scan",
    "pair_tsv_scan", "region_table_scan",
]
