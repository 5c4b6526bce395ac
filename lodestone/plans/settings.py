"""Parameters of the registered queries."""

QUERY = "que thor ble"
QUERY_TERMS = QUERY.split()
SEMANTIC_ID = "n00000000"
WHO = "the"
ASK_CHARS = 2000
TAIL_BYTES = 600
#: The test vectors are nearly random, so thresholds are below production's.
COSINE_LEAST = 0.3
RECUR_COSINE = -0.2
#: Vector searches ask for every row whose number this divides, against all rows.
ASK_EVERY = 50
ALLOW, DENY = ["/workshop/p1", "/workshop/p2"], ["/workshop/p2", "/workshop/p3"]
#: What the queries' caller says to classes of failure.
HINTS = {"extractor-timeout": "raise the time limit for reading a session", "extractor-unavailable": "start the program that reads sessions"}
