"""Training-data operators (secrets, chat formatting, dedup, quality, mixing ...).

One module per operator; each registers its thin ``opN_<name>`` query (and the
DuckDB SQL where SQL can express it) in ``registry``; ``catalog`` imports them
all.  Nothing outside this package imports it; ``__spark_entry__.py`` adds its
queries when it is there.
"""
