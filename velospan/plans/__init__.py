"""Jobs that chain operators: file ledger, ingest, replay export, SQL catalog."""
