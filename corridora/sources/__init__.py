"""Sources and sinks: JSON floors, bit planes, report logs, tables with clipped scans."""
