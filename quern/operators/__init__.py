"""Data structures as relations: strings, hashes, lists, sets, sorted sets, geo, streams, documents."""
