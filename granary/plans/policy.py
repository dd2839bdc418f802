"""Policy constants of the curation plan; operators take them as parameters."""

from __future__ import annotations

# Fixed values.
LEAST_N50 = 10_000_000
LONG_SEQUENCE = 10_000_000
LEAST_LONG_FRACTION = 0.80
LEAST_NUCLEAR_FRACTION = 0.90
MOST_N_FRACTION = 0.10
MOST_N_FRACTION_SKETCH = 0.20
ACCESS_LEVELS = ("public",)
LICENSES = ("open",)
CONTEXTS = (1024, 8192, 32768, 65536, 131072, 262144)
LEAST_COMPLETE_GENOME = LEAST_COMPLETE_ANNOTATION = 90.0
CHUNK_LENGTH, LEAST_CHUNK, LEAST_ACGT_SHARE = 1_000_000, 3_000, 0.5
LEAST_EVALUATED, MOST_PROKARYOTIC, MOST_VECTOR = 0.95, 0.005, 0.0001
VECTOR_RULES = ((50, 90.0), (30, 95.0))
KMER, SCALE = 31, 10_000
RELATED, NEAR_DUPLICATE = 0.80, 0.95
SPECIES_POWER, MEMBER_POWER = 0.3, 0.5
MASK_SHARE, MEAN_SPAN = 0.15, 3.0
