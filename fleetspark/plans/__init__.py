"""End-to-end plans (usage report, reconcile, snapshot audit, health check)
and the registered queries that exercise each operator on the fixture views."""
