"""Operations of a training-data pipeline: search, language, duplicates, quality, chat, mixing, shards, tokens, URLs.

Nothing outside this subpackage imports it.
"""
