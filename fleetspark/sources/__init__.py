"""Sources and sinks: driver tables, fixture views, journals, inventories."""
