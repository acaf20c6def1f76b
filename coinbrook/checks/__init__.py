"""Every operator run on the test tables, and the same in plain SQL to compare with."""
