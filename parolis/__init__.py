"""parolis: analytics over recorded conversations, expressed as Spark plans.

Sub-packages: ``sources`` and ``sinks`` read and write the domain formats, ``functions`` holds column
expressions and the few Arrow UDFs, ``operators`` holds DataFrame-to-DataFrame operators, ``plans`` binds them to
the driver tables as named queries with their SQL, ``streaming`` holds the incremental variant of talk time.
"""
