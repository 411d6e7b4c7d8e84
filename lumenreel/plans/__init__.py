"""From structures to decisions: routes, extraction plans and scans."""
