"""Brand-abuse and phishing-site triage as set-at-a-time Spark jobs."""
