"""All queries of the library, outside the training-data part, with their SQL."""

from . import areas, blocks, bridges, codec, codestreams, features, formats, records

QUERIES = bridges.QUERIES | records.QUERIES | features.QUERIES | formats.QUERIES | codestreams.QUERIES | codec.QUERIES | areas.QUERIES | blocks.QUERIES
ORACLES = bridges.ORACLES | records.ORACLES | features.ORACLES | formats.ORACLES | codestreams.ORACLES | codec.ORACLES | areas.ORACLES | blocks.ORACLES
