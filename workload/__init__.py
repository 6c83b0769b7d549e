"""Trip, station, route and ledger tables derived from the driver's tables, and queries over them."""
