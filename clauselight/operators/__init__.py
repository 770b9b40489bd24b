"""DataFrame -> DataFrame operators: reports, keyed changes, validation, joins."""
