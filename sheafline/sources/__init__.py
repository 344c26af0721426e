"""Where rows come from and go to: files, workbooks, archives, chat exports."""
